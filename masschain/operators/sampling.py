"""Sampled uncertainty bands: seeded draws by edge and sample, path products, means and percentiles.

A draw comes from a hash of seed, edge and sample number, so it is the same on any
partitioning and in any rerun. Distributions are transforms of uniform draws; those of
whole-numbered shapes (gamma, beta) are sums of exponential ones.
"""

from __future__ import annotations

SAMPLES, SEED = 16, 42
PERCENTILES = (0.05, 0.5, 0.95)
#: kind of the distribution of an element's edges
KINDS = {"ECONOMY": "uniform", "LARGE": "triangular", "MEDIUM": "rectangular", "PROMO": "normal", "SMALL": "lognormal", "STANDARD": "weibull"}


def uniform(seed: int, *key: str, hex_to_number: str) -> str:
    """SQL of a draw in (0, 1); hex_to_number: how the engine reads eight hexadecimal digits."""
    text = "concat_ws('|', " + ", ".join([f"'{seed}'", *(f"CAST({k} AS STRING)" for k in key)]) + ")"
    return f"((CAST({hex_to_number.format(f'substr(md5({text}), 1, 8)')} AS DOUBLE) + 0.5E0) / 4294967296.0E0)"


def draw(kind: str, u: str, v: str) -> str:
    """SQL of a draw around elem_best within lo and hi, not below 0, from two uniform ones."""
    sd = "(hi - elem_best) / sqrt(3.0E0)"
    normal = f"sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"
    forms = {
        "uniform": f"lo + (hi - lo) * {u}", "rectangular": f"lo + (hi - lo) * {u}",
        "triangular": f"CASE WHEN {u} < 0.5E0 THEN lo + (hi - lo) * sqrt({u} / 2) ELSE hi - (hi - lo) * sqrt((1 - {u}) / 2) END",
        "normal": f"elem_best + {sd} * {normal}",
        "lognormal": f"elem_best * exp({sd} / elem_best * {normal} - 0.5E0 * power({sd} / elem_best, 2))",
        "weibull": f"elem_best * power(-ln({u}), 0.25E0) / 0.9064024770554773E0",
        "gamma": f"elem_best * (-ln({u}) - ln({v})) / 2", "beta": f"lo + (hi - lo) * ln({u}) / (ln({u}) + ln({v}))",
    }
    return f"greatest({forms[kind]}, 0.0E0)"


def _draws(engine: str, samples: int, seed: int) -> str:
    """One row for each edge (with its path's product above it) and sample."""
    spark = engine == "spark"
    read = "conv({}, 16, 10)" if spark else "CAST(concat('0x', {}) AS BIGINT)"
    u, v = uniform(seed, "ord", "sup", "prt", "sample", "0", hex_to_number=read), uniform(seed, "ord", "sup", "prt", "sample", "1", hex_to_number=read)
    arms = " ".join(f"WHEN '{e}' THEN {draw(k, 'u', 'v')}" for e, k in KINDS.items())
    numbers = f"explode(sequence(0, {samples - 1}))" if spark else f"unnest(range(0, {samples}))"
    return f"""SELECT ord, sup, prt, sample, product_class, product_parent, yr, element_class, f1, f2, elem_best, CASE element_class {arms} ELSE elem_best END AS value
        FROM (SELECT *, {u} AS u, {v} AS v FROM (SELECT ord, sup, prt, product_class, product_parent, yr, element_class, f1, f2, elem_best, lo, hi, {numbers} AS sample FROM {{source}}) s) d"""


def _both(text: str, samples: int = SAMPLES, seed: int = SEED, source: str = "ppath") -> tuple[str, str]:
    out = []
    for engine in ("spark", "check"):
        band = "percentile(amount, {}E0)" if engine == "spark" else "quantile_cont(amount, {}E0)"
        bands = ", ".join(f"round({band.format(p)}, 9) AS p{int(p * 100)}" for p in PERCENTILES)
        out.append(text.replace("{draws}", _draws(engine, samples, seed).replace("{source}", source)).replace("{bands}", bands))
    return tuple(out)


#: Amounts of a leaf slice by sample: the mean over all its products of what their paths sum to.
_LEAF = "SELECT d.product_class, d.product_parent, d.yr, d.element_class, d.sample, SUM(d.f1 * d.f2 * d.value) / MIN(n.n) AS amount FROM ({draws}) d JOIN n_products n ON d.product_class = n.product_class AND d.yr = n.yr GROUP BY d.product_class, d.product_parent, d.yr, d.element_class, d.sample"


def mc_band(segment: str = "BUILDING", samples: int = SAMPLES, seed: int = SEED) -> tuple[str, str]:
    """Bands of the slices under a segment and of its own slices, which take means sample by sample."""
    scope = f"(SELECT * FROM ppath WHERE product_parent = '{segment}') p"
    return _both(f"""SELECT class, element_class, {{bands}} FROM (SELECT concat(product_class, '_Y', CAST(yr AS STRING)) AS class, element_class, sample, amount FROM ({_LEAF}) l
        UNION ALL SELECT concat(product_parent, '_Y', CAST(yr AS STRING)), element_class, sample, AVG(amount) FROM ({_LEAF}) l GROUP BY product_parent, yr, element_class, sample) b GROUP BY class, element_class""", samples, seed, scope)


def mc_leaf_band_only(segment: str = "BUILDING") -> tuple[str, str]:
    """The band only of classes that are no mean of others, widened to hold the best value."""
    scope = f"(SELECT * FROM ppath WHERE product_parent = '{segment}') p"
    return _both(f"""SELECT m.class, m.element_class, round(m.amount, 9) AS best, least(b.p5, round(m.amount, 9)) AS low, greatest(b.p95, round(m.amount, 9)) AS high
        FROM (SELECT class, element_class, amount FROM slice_mean UNION ALL SELECT class, element_class, amount FROM mean_1) m
        LEFT JOIN (SELECT concat(product_class, '_Y', CAST(yr AS STRING)) AS class, element_class, {{bands}} FROM ({_LEAF}) l GROUP BY product_class, yr, element_class) b
        ON m.class = b.class AND m.element_class = b.element_class AND NOT EXISTS (SELECT 1 FROM gate g WHERE g.parent = m.class) WHERE m.class LIKE '{segment}%'""", source=scope)


def _signature(where: str) -> str:
    """Per class, a hash of its statements and the parameters."""
    item = "concat_ws('|', source_id, CAST(ord AS STRING), CAST(sup AS STRING), CAST(prt AS STRING), CAST(CAST(round(kg * 1000, 0) AS BIGINT) AS STRING))"
    return f"SELECT product_class, md5(concat('{SAMPLES}|{SEED}|', CAST(COUNT(*) AS STRING), '|', CAST(SUM(part1) AS STRING), '|', CAST(SUM(part2) AS STRING))) AS signature FROM (SELECT p.product_class, {{number}} FROM (SELECT *, md5({item}) AS h FROM facts) f JOIN placed p ON f.ord = p.ord WHERE {where}) s GROUP BY product_class"


def mc_reuse() -> tuple[str, str]:
    """Which classes' bands can be reused after a source was added: those whose statements and parameters are unchanged."""
    text = f"SELECT a.product_class, CASE WHEN b.signature = a.signature THEN 'reuse' ELSE 'sample' END AS action FROM ({_signature('TRUE')}) a LEFT JOIN ({_signature(chr(123) + 'old' + chr(125))}) b ON a.product_class = b.product_class"
    old = "NOT (p.yr = 1998 AND f.source_id = 'A' AND p.product_parent = 'BUILDING')"
    read = ("CAST(conv(substr(h, {}, 8), 16, 10) AS BIGINT)", "CAST(concat('0x', substr(h, {}, 8)) AS BIGINT)")
    return tuple(text.replace("{old}", old).replace("{number}", f"{r.format(1)} AS part1, {r.format(9)} AS part2") for r in read)


def band_override(segment: str = "BUILDING") -> str:
    """Amounts with their interval, and another band where a table of bands has one for the class."""
    return f"""SELECT m.product_class, m.yr, m.element_class, round(m.amount, 9) AS amount, round(coalesce(o.low, 0.9E0) * m.amount, 9) AS low, round(coalesce(o.high, 1.1E0) * m.amount, 9) AS high FROM leaf_mean m
        LEFT JOIN (SELECT * FROM (VALUES ('PROMO', 0.8E0, 1.3E0), ('SMALL', 0.95E0, 1.05E0)) AS t(element, low, high)) o ON o.element = m.element_class WHERE m.product_parent = '{segment}'"""


SQL = {
    "sample_edge": _both("SELECT ord, sup, prt, sample, round(value, 9) AS value FROM ({draws}) d WHERE sample < 4", samples=4),
    "mc_band_segment": mc_band(), "mc_leaf_band_only": mc_leaf_band_only(), "mc_reuse": mc_reuse(), "band_override": band_override(),
}
