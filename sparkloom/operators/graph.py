"""Entity graphs: declare, call and import edges, and their rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .components import ranked, staged

CONTAINERS, NODES = ["MODULE", "CLASS"], ["FUNCTION", "METHOD", "CONSTANT", "VARIABLE"]


def call_edges(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst): calls (src, called) to names (id, name). The full called name first; only where no name equals it, its last dotted part. No self-edges; a name of several ids fans out."""
    c = calls.distinct()
    full = c.join(names.select(F.col("id").alias("dst"), F.col("name").alias("called")), "called")
    left = c.join(names.select(F.col("name").alias("called")).distinct(), "called", "left_anti").withColumn("last", F.element_at(F.split("called", r"\."), -1))
    part = left.join(names.select(F.col("id").alias("dst"), F.col("name").alias("last")), "last")
    return full.select("src", "dst").unionByName(part.select("src", "dst")).filter("src <> dst").distinct()


def call_counts(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(src, n): how many edges `call_edges` gives each source that has any, counted by name, so that no name fans out. An id has one name."""
    c, names = calls.distinct(), names.distinct()
    held = names.groupBy("name").agg(F.count(F.lit(1)).alias("n_ids"))
    known = c.join(held.select(F.col("name").alias("called"), F.lit(True).alias("whole")), "called", "left")
    meant = known.select("src", F.when(F.col("whole"), F.col("called")).otherwise(F.element_at(F.split("called", r"\."), -1)).alias("name")).distinct()
    own = names.select(F.col("id").alias("src"), "name", F.lit(1).alias("itself"))
    n = F.col("n_ids") - F.coalesce("itself", F.lit(0))
    return meant.join(held, "name").join(own, ["src", "name"], "left").groupBy("src").agg(F.sum(n).alias("n")).filter("n > 0")


def import_edges(imports: DataFrame, internal: DataFrame) -> DataFrame:
    """(src, dependency, is_external) of imports (src, dependency): external unless it begins with a dot or with any internal path (path).

    The prefixes of a dependency are exploded and joined with the paths, so no
    row is compared with every path.
    """
    d = imports.select("dependency").distinct()
    prefixes = d.select("dependency", F.explode(F.transform(F.sequence(F.lit(1), F.length("dependency")), lambda i: F.substring(F.col("dependency"), F.lit(1), i))).alias("path"))
    inside = prefixes.join(internal.filter("path <> ''").select("path").distinct(), "path", "left_semi").select("dependency").distinct().withColumn("inside", F.lit(True))
    marked = d.join(inside, "dependency", "left")
    external = ~F.startswith("dependency", F.lit(".")) & F.col("inside").isNull()
    return imports.distinct().join(marked.select("dependency", external.alias("is_external")), "dependency").select("src", "dependency", "is_external")


def entity_nodes(entities: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(id, label, kind, container, ord, ...) of entities that are drawn: containers and nodes, limited to `kinds` if it is not empty."""
    e = entities.filter(F.col("entity_type").isin(CONTAINERS + NODES))
    e = e.filter(F.col("entity_type").isin(kinds)) if kinds else e
    node = T.diagram_id(F.col("file_path"), F.col("start_line"), F.when(F.col("name") == "", F.col("entity_type")).otherwise(F.col("name")))
    return e.select("file_path", "ord", "parent", node.alias("id"), T.diagram_label(F.col("name")).alias("label"), F.col("entity_type").alias("kind"), F.col("entity_type").isin(CONTAINERS).alias("is_container"))


def _nearest(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, ord, holder): the nearest drawn container above each entity, by its path."""
    boxes = nodes.filter("is_container").select("file_path", F.col("ord").alias("box"), F.col("id").alias("holder"))
    boxes = boxes.join(entities.select("file_path", F.col("ord").alias("box"), F.col("hierarchy_path").alias("box_path")), ["file_path", "box"])
    e = entities.select("file_path", "ord", "hierarchy_path")
    over = e.join(boxes, "file_path").filter((F.col("box") < F.col("ord")) & F.startswith("hierarchy_path", F.concat("box_path", F.lit("."))))
    return over.groupBy("file_path", "ord").agg(F.max_by("holder", "box").alias("holder"))


def entity_graph(entities: DataFrame, kinds: list[str] | None = None, relations: list[str] | None = None, only_connected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind, holder) and edges (src, dst, label, type) with type declare, call or import; relations limits the labels if not empty."""
    nodes, declares, calls, names, imported = _linked_entities(entities, kinds)
    called = call_edges(calls, names).select("src", "dst", F.lit("calls").alias("label"), F.lit("call").alias("type"))
    edges = declares.unionByName(called).unionByName(imported.select("src", "dst", F.lit("imports").alias("label"), F.lit("import").alias("type")))
    if relations:
        edges = edges.filter(F.col("label").isin(relations))
    outside = imported.select(F.col("dst").alias("id"), T.diagram_label(F.col("dependency")).alias("label"), F.when(F.col("is_external"), "EXTERNAL").otherwise("INTERNAL").alias("kind"), F.lit(None).cast("string").alias("holder")).dropDuplicates(["id"])
    drawn = nodes.select("id", "label", "kind", "holder").unionByName(outside)
    if only_connected:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        drawn = drawn.join(ends, "id", "left_semi").unionByName(drawn.filter(F.col("kind").isin(CONTAINERS)).join(ends, "id", "left_anti"))
    return drawn, edges.join(drawn.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "label", "type").distinct()


def edge_counts(entities: DataFrame) -> DataFrame:
    """(type, n_edges, n_sources) of the edges of `entity_graph`, whose calls are counted and not drawn. Files are parsed once: what the joins read of entities is staged."""
    own = ("file_path", "ord", "parent", "entity_type", "name", "start_line", "hierarchy_path", "calls", "dependencies")
    entities = staged(entities.select(*own), "entities")
    _, declares, calls, names, imported = _linked_entities(entities, None)
    drawn = declares.select("type", "src", "dst").unionByName(imported.select(F.lit("import").alias("type"), "src", "dst")).distinct()
    some = drawn.groupBy("type", "src").agg(F.count(F.lit(1)).alias("n")).unionByName(call_counts(calls, names).select(F.lit("call").alias("type"), "src", "n"))
    return some.groupBy("type").agg(F.sum("n").alias("n_edges"), F.count(F.lit(1)).alias("n_sources"))


def _linked_entities(entities: DataFrame, kinds: list[str] | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, declare edges, calls (src, called), names (id, name) and imports of `entity_graph`."""
    nodes = entity_nodes(entities, kinds)
    holder = _nearest(entities, nodes)
    nodes = nodes.join(holder, ["file_path", "ord"], "left").dropDuplicates(["id"])
    declares = nodes.filter("holder IS NOT NULL").select(F.col("holder").alias("src"), F.col("id").alias("dst"), F.lit("declares").alias("label"), F.lit("declare").alias("type"))
    callers = nodes.filter(F.col("kind").isin("FUNCTION", "METHOD")).select("file_path", "ord", F.col("id").alias("src"))
    calls = callers.join(entities.select("file_path", "ord", F.explode("calls").alias("called")), ["file_path", "ord"]).select("src", "called")
    names = nodes.filter(F.col("kind").isin("FUNCTION", "METHOD")).select("id", F.col("label").alias("name"))
    uses = entities.filter(F.size("dependencies") > 0).join(holder, ["file_path", "ord"]).select(F.col("holder").alias("src"), F.explode("dependencies").alias("dependency"))
    paths = entities.select(F.col("file_path").alias("path")).distinct()
    imported = import_edges(uses, paths).withColumn("dst", F.concat(F.lit("dep_"), F.regexp_replace("dependency", r"[^\p{L}\p{N}]", "_")))
    return nodes, declares, calls, names, imported


#: How edges and their links are drawn.
ARROWS = {"import": "-.->|imports|", "call": "-->|calls|", "declare": "---"}
STYLES = {"call": "stroke:#28a745,stroke-width:2px;", "import": "stroke:#ffc107,stroke-width:1px,stroke-dasharray: 5 5;", "declare": "stroke:#adb5bd,stroke-width:1px;"}


def edge_lines(edges: DataFrame) -> DataFrame:
    """(place, line, style): drawn edges in text order; styles are numbered after the sort, so that they belong to their line."""
    arrow = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in ARROWS.items()], F.lit("-->"))
    lines = edges.select(F.concat(F.lit("  "), "src", F.lit(" "), arrow, F.lit(" "), "dst").alias("line"), "type").distinct()
    style = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in STYLES.items()])
    return ranked(lines, "line", "type").select("place", "line", F.concat(F.lit("  linkStyle "), "place", F.lit(" "), style).alias("style"))


def diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (text): the drawn graph. It is one string, so it is meant for a graph that can be looked at."""
    shape = F.when(F.col("kind") == "EXTERNAL", F.concat(F.lit('(("'), "label", F.lit('"))'))).when(F.col("kind") == "FUNCTION", F.concat(F.lit('("'), "label", F.lit('")'))).otherwise(F.concat(F.lit('["'), "label", F.lit('"]')))
    members = nodes.filter(~F.col("kind").isin(CONTAINERS)).select("holder", F.concat(F.lit("    "), "id", shape).alias("line"))
    inside = members.groupBy("holder").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    boxes = nodes.filter(F.col("kind").isin(CONTAINERS)).join(inside.withColumnRenamed("holder", "id"), "id", "left")
    box = F.concat_ws("\n", F.concat(F.lit("  subgraph "), "id", F.lit('["'), "label", F.lit('"]')), "body", F.lit("  end"))
    first = boxes.select(box.alias("line")).unionByName(inside.filter("holder IS NULL").select(F.col("body").alias("line")))
    drawn = first.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("n"))
    e = edge_lines(edges).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("l"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "style"))), lambda x: x["style"]), "\n").alias("s"))
    return drawn.join(e).select(F.concat_ws("\n", F.lit("graph LR"), "n", F.lit("\n  %% Edges"), "l", F.lit("\n  %% Link Styles"), "s").alias("text"))
