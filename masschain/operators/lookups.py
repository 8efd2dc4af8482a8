"""Lookups over the served view and the edges, each a function of one or a few parameters.

A parameter goes into the text as a literal, so that the filter reaches the scan. The
registered queries pass the parameters that stand beside them.
"""

from __future__ import annotations


def lit(value: str | int) -> str:
    """An SQL literal."""
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def view_lookup(product: str) -> str:
    return f"SELECT yr, element_class, round(amount, 9) AS amount FROM v_leaf_mean WHERE product_class = {lit(product)}"


def constituent_first(element: str) -> str:
    return f"SELECT product_class, yr, round(amount, 9) AS amount FROM v_leaf_mean WHERE element_class = {lit(element)}"


def constituents_ranked(product: str) -> str:
    return f"SELECT element_class, yr, round(amount, 9) AS amount, CAST(row_number() OVER (PARTITION BY yr ORDER BY round(amount, 9) DESC, element_class) AS BIGINT) AS place FROM v_leaf_mean WHERE product_class = {lit(product)}"


def class_by_label(term: str) -> str:
    return f"SELECT DISTINCT child AS class FROM taxonomy WHERE position({lit(term.lower())} IN lower(child)) > 0"


def class_by_text_under_roots(term: str, roots: tuple[str, ...]) -> str:
    return f"SELECT DISTINCT c.descendant AS class, c.ancestor AS root FROM v_closure c WHERE c.ancestor IN ({', '.join(map(lit, roots))}) AND position({lit(term.lower())} IN lower(c.descendant)) > 0"


def element_by_alt_name(name: str) -> str:
    return f"SELECT DISTINCT p_type FROM part WHERE lower(p_type) = {lit(name.lower())}"


def element_category_members(first: str, second: str) -> str:
    return f"SELECT a.descendant FROM v_closure a JOIN v_closure b ON a.descendant = b.descendant WHERE a.ancestor = {lit(first)} AND b.ancestor = {lit(second)}"


def absolute_kg_per_element(product: str | None = None) -> str:
    where = f" WHERE l.product_class = {lit(product)}" if product else ""
    return f"SELECT l.product_class, l.yr, l.element_class, round(l.amount * i.mass, 6) AS kg FROM v_leaf_mean l JOIN v_item_mass i ON l.product_class = i.product_class AND l.yr = i.yr{where}"


def element_with_band(element: str) -> str:
    """Amounts with their intervals: means of the lower and upper ends over all paths and products."""
    return f"""SELECT t.product_class, t.yr, round(SUM(t.f) / MIN(n.n), 9) AS amount, round(SUM(t.f1 * t.f2 * t.lo) / MIN(n.n), 9) AS low, round(SUM(t.f1 * t.f2 * t.hi) / MIN(n.n), 9) AS high FROM ppath t
        JOIN v_item_mass n ON t.product_class = n.product_class AND t.yr = n.yr WHERE t.element_class = {lit(element)} GROUP BY t.product_class, t.yr"""


def elements_in_product(product: str) -> str:
    return f"SELECT element_class, yr, round(amount, 9) AS amount FROM v_leaf_mean WHERE product_class = {lit(product)} ORDER BY amount DESC, element_class, yr"


def component_in_product_lookup(component: str, segment: str) -> str:
    return f"SELECT product_class, yr, round(share, 9) AS share FROM v_component_share WHERE component_class = {lit(component)} AND product_parent = {lit(segment)}"


def material_in_component_lookup(component: str) -> str:
    return f"SELECT material_class, round(share, 9) AS share FROM v_material_share WHERE component_class = {lit(component)}"


def component_context_lookup(component: str) -> str:
    return f"SELECT product_class, component_class, element_class, round(amount, 9) AS amount FROM v_scope_amount WHERE component_class = {lit(component)}"


def item_mass_of_class(product: str) -> str:
    return f"SELECT yr, round(mass, 6) AS mass FROM v_item_mass WHERE product_class = {lit(product)}"


def item_mass_by_year(segment: str) -> str:
    return f"SELECT product_class, yr, round(mass, 6) AS mass FROM v_item_mass WHERE product_parent = {lit(segment)} ORDER BY yr, product_class"


def instances_of_class(ancestor: str) -> str:
    return f"SELECT p.ord FROM prod p JOIN v_closure c ON p.product_class = c.descendant WHERE c.ancestor = {lit(ancestor)}"


def instance_by_label(first: int, second: int) -> str:
    return f"SELECT ord, product_class FROM prod WHERE ord = {first} OR ord = {second}"


def two_hop_share(material: str) -> str:
    """Two amounts, each with its unit, brought to fractions and multiplied."""
    return f"SELECT pc.ord, cm.material_class, round(SUM(pc.best * (CASE WHEN pc.ord % 2 = 0 THEN cm.best * 1000 ELSE cm.best END) * (CASE WHEN pc.ord % 2 = 0 THEN 0.001E0 ELSE 1 END)), 9) AS share FROM pc JOIN cm ON pc.ord = cm.ord AND pc.sup = cm.sup WHERE cm.material_class = {lit(material)} GROUP BY pc.ord, cm.material_class"


def wholes_containing(component: str) -> str:
    return f"SELECT DISTINCT ord FROM pc WHERE component_class = {lit(component)} ORDER BY ord"


def slice_view(ancestor: str) -> str:
    """Amounts of the classes under one, and of the components in their products."""
    return f"""SELECT 'class' AS kind, product_class AS subject, element_class, round(amount, 9) AS amount, yr FROM v_leaf_mean WHERE product_class IN (SELECT descendant FROM v_closure WHERE ancestor = {lit(ancestor)})
        UNION ALL SELECT 'scope', concat(component_class, '_in_', product_class), element_class, round(amount, 9), 0 FROM v_scope_amount WHERE product_class IN (SELECT descendant FROM v_closure WHERE ancestor = {lit(ancestor)})"""


SQL = {
    "view_lookup": view_lookup("BUILDING/NATION_3"),
    "constituent_first": constituent_first("PROMO"),
    "constituents_ranked": constituents_ranked("BUILDING/NATION_3"),
    "class_by_label": class_by_label("build"),
    "class_by_text_under_roots": class_by_text_under_roots("nation_1", ("Product", "Component")),
    "element_by_alt_name": element_by_alt_name("promo"),
    "element_category_members": element_category_members("Material", "Brand#1"),
    "absolute_kg_per_element": absolute_kg_per_element(),
    "element_with_band": element_with_band("SMALL"),
    "elements_in_product": elements_in_product("MACHINERY/NATION_18"),
    "component_in_product_lookup": component_in_product_lookup("NATION_18", "BUILDING"),
    "material_in_component_lookup": material_in_component_lookup("NATION_6"),
    "component_context_lookup": component_context_lookup("NATION_12"),
    "item_mass_of_class": item_mass_of_class("BUILDING/NATION_8"),
    "item_mass_by_year": item_mass_by_year("FURNITURE"),
    "labelled_constituents": "SELECT l.product_class, l.yr, concat('element ', lower(l.element_class)) AS label, round(l.amount, 9) AS amount FROM v_leaf_mean l",
    "instances_of_class": instances_of_class("BUILDING"),
    "instance_by_label": instance_by_label(1, 7),
    "two_hop_share": two_hop_share("Brand#11"),
    "wholes_containing": wholes_containing("NATION_17"),
    "slice_view": slice_view("FURNITURE"),
}
