"""The end-to-end questions, as functions of classes, years and elements; registered with the parameters beside them.

Each asks for masses with their uncertainty (kg and sigma), or for lists of materials,
components or recovery routes, over all paths of the products asked for.
"""

from __future__ import annotations

from .lookups import lit

#: Elements flagged critical or strategic, and routes by which an element is recovered (over a base metal).
CRITICALITY = "(SELECT * FROM (VALUES ('PROMO', 'CRITICAL', 2023), ('LARGE', 'CRITICAL', 2023), ('SMALL', 'CRITICAL', 2023), ('PROMO', 'STRATEGIC', 2023)) AS t(element, importance, yr))"
RECOVERY = "(SELECT * FROM (VALUES ('PROMO', 'LARGE', 'target', 'smelting'), ('SMALL', 'PROMO', 'main', 'smelting'), ('ECONOMY', 'STANDARD', 'lost', 'leaching'), ('LARGE', CAST(NULL AS STRING), 'target', 'leaching')) AS t(element, base, effectiveness, process))"


def _where(product: str | None = None, segment: str | None = None, component: str | None = None, years: tuple[int, int] | None = None, elements: tuple[str, ...] = ()) -> str:
    tests = [f"t.{column} = {lit(value)}" for column, value in (("product_class", product), ("product_parent", segment), ("component_class", component)) if value]
    tests += [f"t.yr BETWEEN {years[0]} AND {years[1]}"] if years else []
    tests += [f"t.element_class IN ({', '.join(map(lit, elements))})"] if elements else []
    return " AND ".join(tests) or "TRUE"


_MASS = "round(SUM(t.f * t.pmass), 4) AS kg, round(sqrt(SUM(power(t.f * t.pmass * t.sigma_rel, 2))), 6) AS sigma"


def total(**asked) -> str:
    """Mass of elements in products, with its uncertainty."""
    return f"SELECT {_MASS} FROM ppath t WHERE {_where(**asked)}"


def critical_total(**asked) -> str:
    """Mass of all critical elements together; an element with several flags counts once."""
    return f"SELECT {_MASS} FROM ppath t JOIN (SELECT DISTINCT element FROM {CRITICALITY} k WHERE importance = 'CRITICAL') c ON t.element_class = c.element WHERE {_where(**asked)}"


def by(column: str, **asked) -> str:
    """Mass of elements by a class of the path, largest first."""
    return f"SELECT t.{column}, {_MASS} FROM ppath t WHERE {_where(**asked)} GROUP BY t.{column} ORDER BY kg DESC, t.{column}"


def family_demand(family: str, **asked) -> str:
    """Mass of the materials of a family, by material."""
    return f"SELECT t.material_class, round(SUM(t.f1 * t.f2 * t.pmass), 4) AS kg FROM ppath t WHERE t.material_class IN (SELECT descendant FROM v_closure WHERE ancestor = {lit(family)}) AND {_where(**asked)} GROUP BY t.material_class ORDER BY kg DESC, t.material_class"


def material_by_product(material: str, **asked) -> str:
    return f"SELECT t.product_class, round(SUM(t.f1 * t.f2 * t.pmass), 4) AS kg FROM ppath t WHERE t.material_class = {lit(material)} AND {_where(**asked)} GROUP BY t.product_class ORDER BY kg DESC, t.product_class"


def routes_of(elements: tuple[str, ...]) -> str:
    """Components that hold an element, and how it is recovered there as target or main product."""
    return f"SELECT DISTINCT m.component_class, m.element_class, k.process FROM mat m JOIN {RECOVERY} k ON m.element_class = k.element WHERE k.effectiveness IN ('target', 'main') AND m.element_class IN ({', '.join(map(lit, elements))})"


def recovered(**asked) -> str:
    """Critical elements that a base metal of the same component recovers, with their mass."""
    return f"""SELECT t.element_class, {_MASS} FROM ppath t JOIN (SELECT DISTINCT element FROM {CRITICALITY} k WHERE importance = 'CRITICAL') c ON t.element_class = c.element
        WHERE {_where(**asked)} AND EXISTS (SELECT 1 FROM mat b JOIN {RECOVERY} r ON b.element_class = r.base WHERE r.effectiveness IN ('target', 'main') AND r.element = t.element_class AND b.ord = t.ord AND b.sup = t.sup) GROUP BY t.element_class"""


def recovery_table(**asked) -> str:
    """Every critical element and base metal that meet in a component, and how often."""
    return f"""SELECT r.element, r.base, r.process, COUNT(*) AS components FROM (SELECT DISTINCT t.ord, t.sup, t.element_class FROM ppath t WHERE {_where(**asked)}) a JOIN {RECOVERY} r ON a.element_class = r.element
        JOIN (SELECT DISTINCT ord, sup, element_class FROM mat) b ON a.ord = b.ord AND a.sup = b.sup AND b.element_class = r.base GROUP BY r.element, r.base, r.process ORDER BY r.element, r.base"""


SQL = {
    "question_al_diesel": total(product="BUILDING/NATION_6", years=(1995, 1998), elements=("LARGE",)),
    "question_cu_petrol": total(product="MACHINERY/NATION_6", years=(1995, 1998), elements=("PROMO",)),
    "question_cu_hev": total(product="FURNITURE/NATION_6", years=(1995, 1998), elements=("PROMO",)),
    "question_crm_total_bev": critical_total(segment="BUILDING", years=(1995, 1995)),
    "question_crm_total_phev": critical_total(segment="MACHINERY", years=(1995, 1995)),
    "question_ree_in_motor": total(segment="BUILDING", component="NATION_12", elements=("MEDIUM", "ECONOMY")),
    "question_cu_distribution": by("component_class", segment="BUILDING", elements=("PROMO",)),
    "question_al_alloy_demand": family_demand("Brand#1", segment="FURNITURE"),
    "question_cu_by_segment": by("product_class", years=(1996, 1996), elements=("PROMO",)),
    "question_al5_by_segment": material_by_product("Brand#11", years=(1996, 1996)),
    "question_elements_embedded": by("element_class", component="NATION_18"),
    "question_cu_recovery": routes_of(("PROMO", "LARGE")),
    "question_crm_recovered": recovered(segment="BUILDING", years=(1995, 1996)),
    "question_crm_recovered_table": recovery_table(segment="BUILDING"),
    "critical_elements": "SELECT t.product_class, round(SUM(t.f * t.pmass), 4) AS kg FROM ppath t JOIN (SELECT DISTINCT element FROM " + CRITICALITY + " k WHERE importance = 'CRITICAL') c ON t.element_class = c.element GROUP BY t.product_class",
    "all_criticality": f"SELECT k.element, k.importance, k.yr FROM {CRITICALITY} k WHERE EXISTS (SELECT 1 FROM part WHERE p_type = k.element) ORDER BY k.element, k.importance",
    "recoverability_of_contained": f"SELECT r.ord, r.element_class, k.effectiveness FROM reach r LEFT JOIN {RECOVERY} k ON r.element_class = k.element",
    "recoverability_of_element": f"SELECT DISTINCT p_type AS element, k.base, k.process, k.effectiveness FROM part LEFT JOIN {RECOVERY} k ON p_type = k.element",
}
