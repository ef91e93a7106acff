"""Knowledge-graph operators: filters, hyperedges of three kinds, their text, tables and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.digests import low_pairs
from tessella.functions.text import english_list, filled, stable_pick, word_count
from tessella.sources.workdir import written

# The relations that are kept.
KEEP_RELATIONS = [
    "disease_phenotype_positive", "disease_phenotype_negative", "indication", "contraindication", "off-label use", "drug_protein", "drug_effect", "disease_protein", "disease_disease", "exposure_disease",
    "bioprocess_protein", "molfunc_protein", "pathway_protein", "cellcomp_protein", "phenotype_protein", "exposure_protein", "exposure_bioprocess",
]

# Anchor type, relation, and neighbours at most of the neighbour hyperedges.
NEIGHBORS = [
    ("disease", "disease_phenotype_positive", 8), ("disease", "disease_phenotype_negative", 5), ("disease", "disease_protein", 5), ("disease", "disease_disease", 5), ("disease", "indication", 4), ("disease", "contraindication", 4), ("disease", "exposure_disease", 5),
    ("drug", "indication", 4), ("drug", "contraindication", 4), ("drug", "off-label use", 4), ("drug", "drug_protein", 4), ("drug", "drug_effect", 5), ("drug", "drug_drug", 4),
    ("cellular_component", "cellcomp_protein", 5), ("pathway", "pathway_protein", 6), ("biological_process", "bioprocess_protein", 5), ("molecular_function", "molfunc_protein", 4), ("effect/phenotype", "phenotype_protein", 4),
    ("exposure", "exposure_protein", 4), ("exposure", "exposure_bioprocess", 4), ("exposure", "exposure_disease", 4),
]

# Anchor type, relation, phrase, and entities at most of the parts of composite hyperedges.
COMPOSITES = [
    ("disease", "disease_phenotype_positive", "presents with", 4), ("disease", "disease_phenotype_negative", "notably without", 3), ("disease", "indication", "treated with", 3), ("disease", "contraindication", "contraindicated with", 2), ("disease", "exposure_disease", "risk factors include", 3), ("disease", "disease_disease", "co-occurs with", 2),
    ("drug", "indication", "indicated for", 3), ("drug", "drug_protein", "targets", 3), ("drug", "drug_effect", "effects include", 4), ("drug", "contraindication", "contraindicated in", 3),
]

# What joins a part of a composite to what stands before it.
CONNECTORS = {
    "presents with": ", presenting with ", "notably without": ". Notably absent: ", "treated with": ". Treatment includes ", "contraindicated with": ". Contraindicated: ", "risk factors include": ". Risk factors: ", "co-occurs with": ". Often co-occurs with ",
    "indicated for": " is indicated for ", "targets": ", targeting ", "effects include": ". Effects include ", "contraindicated in": ". Contraindicated in ",
}

# Name, the types and relations of both hops of a path.
PATHS = [
    ("symptom_disease_drug", "effect/phenotype", "disease_phenotype_positive", "disease", "indication", "drug"),
    ("disease_protein_drug", "disease", "disease_protein", "gene/protein", "drug_protein", "drug"),
    ("drug_protein_pathway", "drug", "drug_protein", "gene/protein", "pathway_protein", "pathway"),
    ("exposure_disease_phenotype", "exposure", "exposure_disease", "disease", "disease_phenotype_positive", "effect/phenotype"),
    ("comorbidity_drug", "disease", "disease_disease", "disease", "indication", "drug"),
]

# The templates of neighbour hyperedges by relation, those by relation and anchor type
# that go before them, and the templates of paths.
SINGLE = {
    "disease_phenotype_positive": ["{anchor} characteristically presents with {nb}", "{anchor} is clinically associated with {nb}", "Patients with {anchor} typically exhibit {nb}", "Clinical features of {anchor} include {nb}"],
    "disease_phenotype_negative": ["{nb} are typically ABSENT in {anchor}", "{anchor} does NOT present with {nb}", "The absence of {nb} helps distinguish {anchor}"],
    "indication": ["{anchor} is treated with {nb}", "{nb} are indicated for {anchor}", "Approved therapies for {anchor} include {nb}"],
    "contraindication": ["{nb} are CONTRAINDICATED in {anchor}", "Patients with {anchor} should avoid {nb}", "{nb} must NOT be used in {anchor}"],
    "off-label use": ["{nb} have off-label applications in {anchor}"],
    "drug_protein": ["{anchor} targets {nb}", "The molecular targets of {anchor} include {nb}"],
    "drug_effect": ["Known effects of {anchor} include {nb}", "{anchor} produces {nb}"],
    "disease_protein": ["Molecular basis of {anchor} involves {nb}", "{nb} are associated with {anchor}"],
    "disease_disease": ["{anchor} commonly co-occurs with {nb}", "{nb} are frequent comorbidities of {anchor}"],
    "exposure_disease": ["Risk factors for {anchor} include {nb}", "Exposure to {nb} increases risk of {anchor}"],
    "pathway_protein": ["The {anchor} pathway involves {nb}"],
    "bioprocess_protein": ["{anchor} is mediated by {nb}"],
    "molfunc_protein": ["{nb} have the molecular function of {anchor}"],
    "cellcomp_protein": ["{nb} are localized to {anchor}"],
    "phenotype_protein": ["{anchor} is associated with {nb}"],
    "exposure_protein": ["{anchor} exposure affects {nb}"],
    "exposure_bioprocess": ["{anchor} influences {nb}"],
    "drug_drug": ["{anchor} and {nb} share overlapping therapeutic indications"],
}
SINGLE_BY_ANCHOR = {
    ("indication", "disease"): ["{anchor} is treated with {nb}", "{nb} are indicated for {anchor}", "Approved therapies for {anchor} include {nb}"],
    ("indication", "drug"): ["{anchor} is indicated for {nb}", "{anchor} is approved for the treatment of {nb}"],
    ("contraindication", "disease"): ["{nb} are CONTRAINDICATED in {anchor}", "Patients with {anchor} should avoid {nb}", "{nb} must NOT be used in {anchor}"],
    ("contraindication", "drug"): ["{anchor} is contraindicated in patients with {nb}", "{anchor} should NOT be used in {nb}"],
    ("off-label use", "drug"): ["{anchor} has off-label applications in {nb}", "{anchor} is used off-label for {nb}"],
    ("cellcomp_protein", "cellular_component"): ["{nb} are localized to {anchor}", "{nb} are components of the {anchor}"],
    ("exposure_disease", "exposure"): ["{anchor} exposure increases risk of {nb}", "Exposure to {anchor} is associated with {nb}"],
}
PATH_TEMPLATES = {
    "symptom_disease_drug": ["{e0} suggests {e1}, which is treated with {e2}", "The symptom {e0} is a feature of {e1}; therapy includes {e2}"],
    "disease_protein_drug": ["{e0} involves {e1}, which is targeted by {e2}", "{e2} treats {e0} by acting on {e1}"],
    "drug_protein_pathway": ["{e0} targets {e1} in the {e2} pathway", "{e0} modulates {e2} through its action on {e1}"],
    "exposure_disease_phenotype": ["Exposure to {e0} increases risk of {e1}, manifesting as {e2}", "{e0} is a risk factor for {e1}, which presents with {e2}"],
    "comorbidity_drug": ["{e0} often co-occurs with {e1}; {e2} may be used for treatment"],
}


#: Sources of a target all of whose pairs are met; paths through one entity that one task makes; and pieces of one entity's paths, times the shuffle partitions.
LIGHT, PIECE, SPREAD = 100, 500_000, 4
#: First and second edges of an entity in lists that are hashed against each other.
HEADS, TAILS = 2048, 16_384
#: Times ``piece``: paths up to which all are joined, as lists cost more than they save.
LISTED = 200


def template_table() -> list[tuple[str, str, str, list[str]]]:
    """kind, first key, second key, templates: the rows of one configuration table."""
    rows = [("single", r, "", t) for r, t in SINGLE.items()]
    rows += [("anchor", r, a, t) for (r, a), t in SINGLE_BY_ANCHOR.items()]
    return rows + [("path", p, "", t) for p, t in PATH_TEMPLATES.items()]


def _config(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A configuration table of a few rows, to be broadcast; of literals, so no Python worker makes it."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    row = lambda r: F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(t).alias(n) for v, (n, t) in zip(r, fields, strict=True)])
    return F.broadcast(df.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*[row(r) for r in rows]))))


def keep_relations(edges: DataFrame, relations: list[str] = KEEP_RELATIONS) -> DataFrame:
    return edges.where(F.col("relation").isin(relations))


def shared_target_pairs(edges: DataFrame, pair_relation: str = "drug_drug", via: str = "indication", light: int = LIGHT) -> DataFrame:
    """Edges of ``pair_relation`` both of whose ends have a ``via`` edge to one same target.

    Of a target of at most ``light`` sources all pairs of sources are met, at most ``light`` rows a source
    and target. For the few targets of more, the pairs come first: each is extended by its first
    end's targets of that kind, and those are looked up among its second end's. Edges of the two
    relations are written first, as they are read many times; the job runs at the call.
    """
    edges = written(edges.where(F.col("relation").isin(pair_relation, via)), "paired")
    pairs = edges.where(F.col("relation") == pair_relation)
    ends = pairs.select(F.explode(F.array("x_index", "y_index")).alias("s")).distinct()
    has = edges.where(F.col("relation") == via).select(F.col("x_index").alias("s"), F.col("y_index").alias("t")).distinct().join(ends, "s", "left_semi")
    hot = has.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > light).select("t")
    few, many = has.join(hot, "t", "left_anti"), has.join(hot, "t", "left_semi")
    met = few.withColumnRenamed("s", "x_index").join(few.withColumnRenamed("s", "y_index"), "t").select("x_index", "y_index")
    wanted = pairs.select("x_index", "y_index").distinct()
    more = wanted.join(many, F.col("x_index") == F.col("s")).select("x_index", "y_index", "t").join(many.withColumnsRenamed({"s": "s2", "t": "t2"}), (F.col("y_index") == F.col("s2")) & (F.col("t") == F.col("t2")), "left_semi").select("x_index", "y_index")
    return pairs.join(met.unionByName(more).distinct(), ["x_index", "y_index"], "left_semi").select(*edges.columns)


def filter_graph(edges: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """The kept relations, and the pairs that share a target; ``paired`` has the edges that those are sought in, if it isn't ``edges``."""
    return keep_relations(edges).unionByName(shared_target_pairs(edges if paired is None else paired))


def ranked(edges: DataFrame, group: list[str], most: int) -> DataFrame:
    """The first ``most`` edges of each group by y_index and y_name, with their place from 1 as pos.

    The rank's limit goes below the window's shuffle. Rows are sorted by a hash of the group first,
    _group: names mostly begin alike, and a sort tells strings apart quickly only by their first eight
    bytes. To group by it and the group's columns takes no shuffle more.
    """
    w = Window.partitionBy("_group", *group).orderBy("y_index", "y_name")
    return edges.withColumn("_group", F.xxhash64(*group)).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def neighbor_hyperedges(edges: DataFrame, config: list[tuple[str, str, int]] = NEIGHBORS) -> DataFrame:
    """Of each configured (anchor type, relation), the first neighbours of each anchor by y_index.

    Groups of fewer than two neighbours, counted after the cut, are dropped, as are null anchors;
    duplicates stay. The rank limit goes below the window, so a hot anchor ships few rows.
    """
    conf = _config(edges, [(i, *c) for i, c in enumerate(config)], "config long, anchor_type string, relation string, max_n int")
    rows = edges.where("x_name is not null").join(conf, (edges.x_type == conf.anchor_type) & (edges.relation == conf.relation)).select("config", "anchor_type", edges.relation, "max_n", "x_name", "y_index", "y_name", "y_type")
    most = max(n for *_, n in config)
    grouped = ranked(rows, ["config", "x_name"], most).where("pos <= max_n").groupBy("_group", "config", "anchor_type", "relation", F.col("x_name").alias("anchor")).agg(F.sort_array(F.collect_list(F.struct("pos", "y_name", "y_type"))).alias("n"))
    return grouped.where(F.size("n") >= 2).select("config", "anchor", "anchor_type", "relation", F.col("n.y_name").alias("neighbors"), F.col("n.y_type").alias("neighbor_types"))


def composite_hyperedges(edges: DataFrame, config: list[tuple[str, str, str, int]] = COMPOSITES) -> DataFrame:
    """Anchors with at least two of the configured parts, each part its first entities by y_index.

    Neighbours are looked up by the anchor's name alone, so a name under two types has both.
    """
    conf = _config(edges, [(i, *c) for i, c in enumerate(config)], "part long, anchor_type string, relation string, phrase string, max_n int")
    anchors = edges.where(F.col("x_type").isin([c[0] for c in config])).select(F.col("x_name").alias("anchor"), F.col("x_type").alias("anchor_type")).where("anchor is not null").distinct()
    wanted = anchors.join(conf, "anchor_type")
    most = max(c[3] for c in config)
    first = ranked(edges.where(F.col("relation").isin([c[1] for c in config])).select("x_name", "relation", "y_index", "y_name"), ["x_name", "relation"], most)
    rows = wanted.join(first, (F.col("anchor") == F.col("x_name")) & (wanted.relation == first.relation)).where("pos <= max_n")
    parts = rows.groupBy("anchor", "anchor_type", "part", "phrase").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "y_name"))), lambda s: s["y_name"]).alias("names"))
    whole = parts.groupBy("anchor", "anchor_type").agg(F.sort_array(F.collect_list(F.struct("part", "phrase", "names"))).alias("parts")).where(F.size("parts") >= 2)
    return whole.select("anchor", "anchor_type", F.concat(F.array("anchor"), F.flatten(F.col("parts.names"))).alias("entities"), "parts")


def _hops(edges: DataFrame, patterns: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The first edges of the patterns, and the second ones."""
    conf = _config(edges, [(i, *p) for i, p in enumerate(patterns)], "ordinal long, pattern string, t0 string, r1 string, t1 string, r2 string, t2 string")
    hop = edges.select("relation", "x_index", "x_name", "y_index", "y_name")
    first = hop.join(conf, hop.relation == conf.r1).select("ordinal", "pattern", "t0", "r1", "t1", "r2", "t2", F.col("x_index").alias("i0"), F.col("x_name").alias("e0"), F.col("y_index").alias("i1"), F.col("y_name").alias("e1"))
    second = hop.where(F.col("relation").isin([p[4] for p in patterns])).select(F.col("relation").alias("r2"), F.col("x_index").alias("i1"), F.col("y_index").alias("i2"), F.col("y_name").alias("e2"))
    return first, second


def path_middles(edges: DataFrame, patterns: list[tuple] = PATHS) -> DataFrame:
    """Each pattern's entities between two edges: pattern, r2, i1, and the numbers of edges to it, n1, and from it, n2.

    That counts all paths without making one. The job runs at the call.
    """
    first, second = _hops(edges, patterns)
    n1 = first.groupBy("pattern", "r2", "i1").agg(F.count("*").alias("n1"))
    return written(n1.join(second.groupBy("r2", "i1").agg(F.count("*").alias("n2")), ["r2", "i1"]).select("pattern", "r2", "i1", "n1", "n2"), "middles")


def two_hop_paths(edges: DataFrame, patterns: list[tuple] = PATHS, piece: int = PIECE, middles: DataFrame | None = None) -> DataFrame:
    """Paths of two edges by index. Only relations are filtered; types come from the pattern.

    An entity in the middle of more than ``piece`` paths has its first edges dealt to several tasks,
    each of which gets its second edges; ``middles`` are those of ``path_middles``, if they are at hand.
    """
    first, second = _hops(edges, patterns)
    return _joined(first, second, path_middles(edges, patterns) if middles is None else middles, piece)


def _joined(first: DataFrame, second: DataFrame, middles: DataFrame, piece: int) -> DataFrame:
    """The paths of first and second edges; ``middles`` have their numbers, or higher ones."""
    key = ["r2", "i1"]
    tasks = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # No more than the edges by the root of ``piece``.
    n1, n = F.sum("n1"), F.sum(F.col("n1") * F.col("n2"))
    hot = middles.groupBy(*key).agg(F.least(n1, F.ceil(n / piece), F.lit(SPREAD * tasks)).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    deal = lambda df: df.drop("_parts").repartition(tasks, *key, "_part")
    first = deal(first.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64("i0", "ordinal"), parts).cast("int")))
    second = deal(second.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))))
    return first.join(second, [*key, "_part"]).select("ordinal", "pattern", "i0", "i1", "i2", "e0", "e1", "e2", "t0", "t1", "t2", "r1", "r2")


def _low_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's heads and tails the pairs whose digest is below the head's bound."""
    for batch in batches:
        for row in range(len(batch)):
            heads, tails = batch["heads"][row].values, batch["tails"][row].values
            e0, e1, e2 = (pc.cast(pc.struct_field(x, n), pa.binary()).to_pylist() for x, n in ((heads, "e0"), (heads, "e1"), (tails, "e2")))
            whole = [b"|".join(x for x in pair if x is not None) for pair in zip(e0, e1, strict=True)]
            joined = [w if a is None and b is None else w + b"|" for w, a, b in zip(whole, e0, e1, strict=True)]
            bounds = pc.struct_field(heads, "bound").to_numpy(zero_copy_only=False)
            for texts, some in ((joined, [j for j, x in enumerate(e2) if x is not None]), (whole, [j for j, x in enumerate(e2) if x is None])):
                for i, j in low_pairs(texts, bounds, [e2[j] or b"" for j in some]) if some else ():
                    h, t = heads.take(pa.array(i)), tails.take(pa.array(np.array(some)[j]))
                    fixed = [pa.repeat(batch[n][row], len(i)) for n in ("r2", "i1")]
                    yield pa.RecordBatch.from_arrays([*fixed, *(pc.struct_field(h, n) for n in ("ordinal", "i0", "e0", "e1")), *(pc.struct_field(t, n) for n in ("i2", "e2"))], names=["r2", "i1", "ordinal", "i0", "e0", "e1", "i2", "e2"])


def _low_paths(first: DataFrame, second: DataFrame, middles: DataFrame, share: dict[str, float], patterns: list[tuple], piece: int, few: bool = False) -> DataFrame:
    """Paths whose hash is among the lowest ``share`` of their pattern.

    An entity in the middle of more than ``piece`` paths has its edges dealt in lists, and a task hashes all of
    one list against all of another without making the paths as rows; the paths of others are joined; all paths are, if they are ``few``.
    """
    key = ["r2", "i1"]
    tasks = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n1, n2 = F.sum("n1"), F.max("n2")
    heavy = F.broadcast(middles.groupBy(*key).agg(F.ceil(n1 / HEADS).alias("_heads"), F.ceil(n2 / TAILS).alias("_tails"), (n1 * n2).alias("_n")).where(F.col("_n") > piece).drop("_n"))
    name, digest = F.col("pattern"), F.md5(F.concat_ws("|", "e0", "e1", "e2"))
    below, bound = F.lit(True), F.lit(2**32)
    for p, s in share.items():
        most = int(min(1.0, s) * 2**32)
        below = F.when(name.eqNullSafe(F.lit(p)), F.lit(True) if s >= 1 else digest < f"{most:08x}").otherwise(below)
        bound = F.when(name.eqNullSafe(F.lit(p)), F.lit(most)).otherwise(bound)
    if few:
        return _joined(first, second, middles, piece).where(below)
    light = first.join(heavy, key, "left_anti").join(second.join(heavy, key, "left_anti"), key).where(below)
    dealt = lambda df, place, parts: F.pmod(F.xxhash64(*place), F.col(parts)).alias("_part")
    heads = first.join(heavy, key).select(*key, dealt(first, ["i0", "ordinal"], "_heads"), F.struct("ordinal", bound.cast("long").alias("bound"), "i0", "e0", "e1").alias("h")).groupBy(*key, "_part").agg(F.collect_list("h").alias("heads"))
    tails = second.join(heavy, key).select(*key, dealt(second, ["i2"], "_tails"), F.struct("i2", "e2").alias("t")).groupBy(*key, "_part").agg(F.collect_list("t").alias("tails")).withColumnRenamed("_part", "_part2")
    lists = heads.join(tails, key).repartition(tasks, *key, "_part", "_part2").select(*key, "heads", "tails")
    found = lists.mapInArrow(_low_pairs, "r2 string, i1 long, ordinal long, i0 long, e0 string, e1 string, i2 long, e2 string")
    conf = _config(first, [(i, *p) for i, p in enumerate(patterns)], "ordinal long, pattern string, t0 string, r1 string, t1 string, r2 string, t2 string").drop("r2")
    columns = ["ordinal", "pattern", "i0", "i1", "i2", "e0", "e1", "e2", "t0", "t1", "t2", "r1", "r2"]
    return light.select(*columns).unionByName(found.join(conf, "ordinal").select(*columns))


def capped_paths(edges: DataFrame, limit: int, priority: DataFrame | None = None, patterns: list[tuple] = PATHS, piece: int = PIECE) -> DataFrame:
    """``cap_paths`` of all two-hop paths, which are counted by their middles and hashed without being made.

    A path is through a priority entity if one of its edges has one, so edges are told apart, not paths.
    """
    middles = path_middles(edges, patterns)
    sizes = {r["pattern"]: r["n"] for r in middles.groupBy("pattern").agg(F.sum(F.col("n1") * F.col("n2")).alias("n")).collect()}  # one row a pattern
    first, second = _hops(edges, patterns)
    few = sum(sizes.values()) <= LISTED * piece
    if priority is None:
        return _lowest(lambda share: _low_paths(first, second, middles, share, patterns, piece, few), limit, sizes).drop("_rn")
    # Written first, so that a short list is known to be one when the paths are planned.
    names = written(priority.select(F.col("name").alias("_name")).where("name is not null").distinct(), "names")
    named = lambda df, ends, how: reduce(lambda d, e: d.join(names, F.col(e) == F.col("_name"), how), ends, df)
    told = reduce(lambda d, e: d.join(names.withColumnRenamed("_name", f"_{e}"), F.col(e) == F.col(f"_{e}"), "left"), ["e0", "e1"], first)
    ahead_first = told.where("_e0 is not null or _e1 is not null").drop("_e0", "_e1")
    rest_first, rest_second, ahead_second = named(first, ["e0", "e1"], "left_anti"), named(second, ["e2"], "left_anti"), named(second, ["e2"], "left_semi")
    ahead = _joined(ahead_first, second, middles, piece).unionByName(_joined(rest_first, ahead_second, middles, piece))
    # Numbers of the rest: those of all paths would raise bounds in vain.
    n1 = rest_first.groupBy("pattern", "r2", "i1").agg(F.count("*").alias("n1"))
    left = written(n1.join(rest_second.groupBy("r2", "i1").agg(F.count("*").alias("n2")), ["r2", "i1"]).select("pattern", "r2", "i1", "n1", "n2"), "middles")
    others = {r["pattern"]: r["n"] for r in left.groupBy("pattern").agg(F.sum(F.col("n1") * F.col("n2")).alias("n")).collect()}  # one row a pattern
    rest = _lowest(lambda share: _low_paths(rest_first, rest_second, left, share, patterns, piece, few), limit, others)
    # One row a pattern: all of its paths but those of the rest.
    filled = [(p, n - others.get(p, 0)) for p, n in sizes.items()]
    taken = reduce(lambda c, x: F.when(F.col("pattern").eqNullSafe(F.lit(x[0])), F.lit(x[1])).otherwise(c), filled, F.lit(0))
    return ahead.unionByName(rest.where(F.col("_rn") + taken <= limit).drop("_rn"))


def _first_by_hash(paths: DataFrame, limit: int, sizes: dict[str, int] | None = None) -> DataFrame:
    """The first ``limit`` paths of a pattern by a hash of their ends, with their place as _rn.

    Only paths of hashes low enough to hold twice the limit are put in order; ``sizes`` are the numbers of
    a pattern's paths, or more, which are counted if they aren't given. If they are too few after all, the bound
    is raised until all are in. The jobs run at the call.
    """
    name, key = F.col("pattern"), F.md5(F.concat_ws("|", "e0", "e1", "e2"))
    if sizes is None:
        sizes = {r["pattern"]: r["n"] for r in paths.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # one row a pattern

    def low(share: dict[str, float]) -> DataFrame:
        below = F.lit(True)
        for p, s in share.items():
            below = F.when(name.eqNullSafe(F.lit(p)), F.lit(True) if s >= 1 else key < f"{int(s * 2**32):08x}").otherwise(below)
        return paths.where(below)

    return _lowest(low, limit, sizes)


def _lowest(low: Callable[[dict[str, float]], DataFrame], limit: int, sizes: dict[str, int]) -> DataFrame:
    """The first ``limit`` paths of a pattern by hash, with their place as _rn; ``low`` gives those of the lowest shares of hashes by pattern."""
    share = {p: 2 * limit / n for p, n in sizes.items()}
    w = Window.partitionBy("pattern").orderBy("_key", "i0", "i1", "i2")
    while True:
        keyed = low(share).withColumn("_key", F.md5(F.concat_ws("|", "e0", "e1", "e2")))
        found = written(keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit), "paths")
        counts = {r["pattern"]: r["n"] for r in found.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
        short = [p for p, n in sizes.items() if counts.get(p, 0) < min(limit, n) and share[p] < 1]
        if not short:
            return found.drop("_key")
        share |= {p: share[p] * 16 for p in short}


def cap_paths(paths: DataFrame, limit: int, priority: DataFrame | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """At most ``limit`` paths of a pattern, by a hash of their ends; all paths through a priority
    entity stay, and fill the limit first, so that there can be more. ``sizes`` are the numbers of paths by pattern, if they are known."""
    columns = paths.columns
    if priority is None:
        return _first_by_hash(paths, limit, sizes).select(*columns)
    # Written first, so that a short list is known to be one when the paths are planned.
    names = written(priority.select(F.col("name").alias("_name")).where("name is not null").distinct(), "names")
    first = F.lit(False)
    for e in ("e0", "e1", "e2"):
        paths = paths.join(names.withColumnRenamed("_name", f"_{e}"), F.col(e) == F.col(f"_{e}"), "left")
        first = first | F.col(f"_{e}").isNotNull()
    flagged = paths.withColumn("_first", first).select(*columns, "_first")
    ahead = flagged.where("_first").select(*columns)
    # Those ahead are among ``sizes``: a bound that is too low for the rest is raised.
    rest = _first_by_hash(flagged.where("not _first").select(*columns), limit, sizes)
    filled_by = F.broadcast(ahead.groupBy("pattern").agg(F.count("*").alias("_n")))  # one row a pattern
    rest = rest.join(filled_by, "pattern", "left").where(F.col("_rn") + F.coalesce("_n", F.lit(0)) <= limit)
    return ahead.unionByName(rest.select(*columns))


def _picked(templates: Column, key: Column) -> Column:
    return F.element_at(templates, (stable_pick(key, F.size(templates)) + 1).cast("int"))


def verbalize_neighbors(hedges: DataFrame) -> DataFrame:
    """A description by the template of relation and anchor type, or else of the relation, or plain."""
    rows = template_table()
    by_anchor = _config(hedges, [(a, b, t) for k, a, b, t in rows if k == "anchor"], "relation string, anchor_type string, t1 array<string>")
    single = _config(hedges, [(a, t) for k, a, _, t in rows if k == "single"], "relation string, t2 array<string>")
    out = hedges.join(by_anchor, ["relation", "anchor_type"], "left").join(single, "relation", "left")
    template = _picked(F.coalesce("t1", "t2", F.array(F.lit("{anchor} is related to {nb}"))), F.concat_ws("|", "relation", "anchor"))
    return out.withColumn("description", filled(template, anchor=F.col("anchor"), nb=english_list(F.col("neighbors")))).select(*hedges.columns, "description")


def verbalize_composites(hedges: DataFrame) -> DataFrame:
    connectors = F.create_map(*[F.lit(x) for kv in CONNECTORS.items() for x in kv])
    said = F.transform("parts", lambda p: F.concat(connectors[p["phrase"]], english_list(p["names"])))
    return hedges.withColumn("description", F.concat("anchor", F.array_join(said, ""), F.lit(".")))


def verbalize_paths(paths: DataFrame) -> DataFrame:
    rows = _config(paths, [(a, t) for k, a, _, t in template_table() if k == "path"], "pattern string, t array<string>")
    plain = F.array(F.concat(F.lit("{e0} ("), F.col("r1"), F.lit(") {e1} ("), F.col("r2"), F.lit(") {e2}")))
    template = _picked(F.coalesce("t", plain), F.concat_ws("|", "pattern", "e0", "e1", "e2"))
    return paths.join(rows, "pattern", "left").withColumn("description", filled(template, e0=F.col("e0"), e1=F.col("e1"), e2=F.col("e2"))).select(*paths.columns, "description")


def dense_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Numbers from 0 in the total order of ``order``, without bringing the rows to one task.

    Rows are dealt by range, as many ranges as the session has shuffle partitions, and sorted there.
    They are written once with their range and place, since a range is drawn by sampling and would
    not be the same in a second run of the plan; each place is moved on by the rows in the ranges
    before it. Rows that tie in ``order`` get numbers in any order. The rows are written before they are
    dealt, so that the sample doesn't make them a second time. The jobs run at the call.
    """
    df = written(df, "unordered")
    place = F.monotonically_increasing_id()  # range number * 2**33 + place in it
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "ordered")
    span, local = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(span.alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")  # one row a range
    return dealt.withColumn("_range", span).join(F.broadcast(before), "_range").withColumn(name, local + F.col("_before")).drop("_range", "_place", "_before")


def hypergraph(edges: DataFrame, path_limit: int = 5000, priority: DataFrame | None = None) -> DataFrame:
    """All hyperedges: id, type, relation, anchor, entities, entity_types and description.

    Ids follow the order of neighbours, composites, paths, each by configuration and names.
    """
    n = verbalize_neighbors(neighbor_hyperedges(edges)).select(
        F.lit(0).alias("k"), "config", F.lit("neighbor_agg").alias("type"), "relation", "anchor", F.concat(F.array("anchor"), "neighbors").alias("entities"), F.concat(F.array("anchor_type"), "neighbor_types").alias("entity_types"), "description", F.col("anchor").alias("o"),
    )
    kind = F.when(F.col("anchor_type") == "disease", 0).otherwise(1)
    c = verbalize_composites(composite_hyperedges(edges)).select(
        F.lit(1).alias("k"), kind.cast("long").alias("config"), F.lit("composite").alias("type"), F.lit("").alias("relation"), "anchor", "entities", F.concat(F.array("anchor_type"), F.array_repeat(F.lit("unknown"), F.size("entities") - 1)).alias("entity_types"), "description", F.col("anchor").alias("o"),
    )
    p = verbalize_paths(capped_paths(edges, path_limit, priority)).select(
        F.lit(2).alias("k"), F.col("ordinal").alias("config"), F.lit("path").alias("type"), F.col("pattern").alias("relation"), F.col("e0").alias("anchor"), F.array("e0", "e1", "e2").alias("entities"), F.array("t0", "t1", "t2").alias("entity_types"), "description", F.concat_ws("|", "e0", "e1", "e2").alias("o"),
    )
    rows = dense_ordinal(reduce(DataFrame.unionByName, [n, c, p]), ["k", "config", "o", "description"])
    return rows.select(F.format_string("he_%06d", "ordinal").alias("id"), F.col("ordinal").alias("hedge_ord"), "type", "relation", "anchor", "entities", "entity_types", "description")


def entity_hedges(hedges: DataFrame) -> DataFrame:
    """The inverted index: a row for each occurrence of an entity in a hyperedge."""
    return hedges.select("id", "hedge_ord", F.posexplode(F.arrays_zip("entities", "entity_types")).alias("pos", "e")).select(F.col("e.entities").alias("name"), F.col("e.entity_types").alias("type"), "id", "hedge_ord", "pos")


def entities(index: DataFrame) -> DataFrame:
    """Each entity with the type of its first occurrence."""
    return index.groupBy("name").agg(F.min_by("type", F.struct("hedge_ord", "pos")).alias("type"))


def intrinsic_report(hedges: DataFrame) -> DataFrame:
    """Sizes and rates of a hypergraph, one row."""
    index = entity_hedges(hedges)
    size = F.size("entities")
    h = hedges.agg(
        F.count("*").alias("n_hedges"), F.round(F.avg(size), 6).alias("mean_entities"), F.min(size).cast("long").alias("min_entities"), F.max(size).cast("long").alias("max_entities"),
        F.round(F.avg(word_count(F.col("description"))), 6).alias("mean_words"), F.round(F.expr("percentile(size(filter(split(description, '\\\\s+'), w -> w <> '')), 0.5)"), 6).alias("median_words"),
        F.count_if(F.regexp_like("description", F.lit(r"\{(anchor|nb|e[0-9])\}"))).alias("placeholder_leaks"), F.count_if(F.trim("description") == "").alias("empty_descriptions"),
        F.count_if(F.array_contains("entities", "")).alias("empty_entities"), F.count_if((F.col("type") == "composite") & ~F.rtrim("description").endswith(".")).alias("open_composites"),
    )
    per = index.select("name", "id").distinct().groupBy("name").agg(F.count("*").alias("n"))
    e = per.agg(F.count("*").alias("n_entities"), F.round(F.avg("n"), 6).alias("mean_hedges"), F.round(F.percentile("n", 0.5), 6).alias("median_hedges"), F.round(F.avg((F.col("n") == 1).cast("int")), 6).alias("low_connectivity"))
    d = hedges.groupBy("description").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated"), F.sum("n").alias("_all"))
    d = d.select("duplicated", F.round(F.try_divide("duplicated", "_all"), 6).alias("duplicate_share"))
    return h.crossJoin(e).crossJoin(d)  # one row each


def checks(report: DataFrame) -> DataFrame:
    """The report's pass and fail: check, passed."""
    rules = [("no placeholder leaks", "placeholder_leaks = 0"), ("no empty descriptions", "empty_descriptions = 0"), ("no empty entities", "empty_entities = 0"), ("few duplicates", "duplicate_share < 0.001"), ("connected", "low_connectivity < 0.5")]
    return report.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.expr(r).alias("passed")) for n, r in rules])).alias("c")).select("c.*")
