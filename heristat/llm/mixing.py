"""Mixing sources to target weights, with DataFrame and SQL functions alone.

Words per source are shared out by weight with a ceiling (water filling). A source's documents are permuted by a keyed
hash; the top bits of the hash name its block. A source gives whole passes over its blocks and then a prefix of the
permutation that ends within half a document of the target. The blocks so drawn are the source's quota, a ticket each. A
splitting tree deals the quotas to output shards: each node splits its quotas between its two children by a multivariate
hypergeometric draw (one source after the other, each a univariate draw by inversion of the distribution function), so
that all quotas are met exactly and every shard gets its number of blocks. A shard then takes disjoint blocks of each
source in permuted order, and shuffles its own documents. What a document gives is what the tickets of its block give.

A node holds BUNDLES quotas at most, however many sources there are: sources whose ranks agree modulo BUNDLES are a
bundle, whose tickets are permuted together. Dealing a permutation's prefix to the left draws its sources' counts from
the same hypergeometric distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DataType, MapType

from heristat.llm.common import WORD, bounded, columns, materialize, quoted, whole

SEED, CEILING = 17, 3
#: Shards: a power of two, at least so many, and enough that none has more words than SHARD_WORDS on average.
SHARDS, SHARD_WORDS = 64, 1 << 24
#: A document's key has 60 bits, whose top ones name its block; a source has 64 blocks for each shard.
KEY_BITS, SHARD_BLOCK_BITS = 60, 6
BUNDLES = 256


def _has_map(kind: DataType) -> bool:
    inner = [f.dataType for f in getattr(kind, "fields", [])] + [x for x in (getattr(kind, "elementType", None),) if x is not None]
    return isinstance(kind, MapType) or any(map(_has_map, inner))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, with_rows: bool) -> DataFrame:
    """Rows (_src, _key, _hash) and either (doc_id, _size) or docs' columns as one, row. _src is never null, _key depends on
    id and text, _hash on every column: rows that have both alike are equal."""
    text = F.col(quoted(text_col)).cast("string")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    cells = [F.to_json(F.struct(c)) if _has_map(f.dataType) else c for c, f in zip(columns(docs), docs.schema.fields)]
    own = [
        F.coalesce(F.concat(F.lit("="), F.col(quoted(source_col)).cast("string")), F.lit("")).alias("_src"),
        F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long").alias("_key"),
        F.xxhash64(*cells, *(c.isNull() for c in columns(docs))).alias("_hash"),
    ]
    if with_rows:
        return docs.select(whole(docs).alias("row"), *own)
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), *own)


def numbered(df: DataFrame, order: list, name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with a column name: 0, 1, ... in a total order, and for each column of sums, as _before_<it>, its sum over the rows
    ahead. Rows are sorted by ranges; a task knows its own range and what comes before it, never all rows."""
    at, part = f"_at_{name}", f"_part_{name}"
    mine = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), name).withColumn(part, F.shiftright(at, 33))
    totals = mine.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_all_{c}") for c in sums))
    ahead = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    over = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    first = totals.select(part, over("_n").alias("_first"), *(over(f"_all_{c}").alias(f"_first_{c}") for c in sums))
    inside = W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    found = mine.join(F.broadcast(first), part).withColumns({
        name: F.col("_first") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)),
        **{f"_before_{c}": F.col(f"_first_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums},
    })
    return found.select(*df.columns, name, *(f"_before_{c}" for c in sums))


def targets(per_source: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """per_source (_src, size) plus rank (from 0, by code point, null last), weight and target. No sources: no rows.

    Weights are 1, 2, 3, 1, ... by rank. With the sources sorted by ceiling x size / weight, those before the water line
    are at their ceiling and the rest share what is left by weight.
    """
    named = numbered(per_source, [F.col("_src") == "", F.col("_src")], "rank").withColumn("weight", F.col("rank") % 3 + 1)
    filled = named.withColumn("full_at", F.expr(f"CAST({ceiling} * size AS DOUBLE) / weight")).withColumn("full", ceiling * F.col("size"))
    line = materialize(numbered(filled, ["full_at", "_src"], "by_fill", ("full", "weight")), "line")
    words, weights = line.agg(F.sum("size"), F.sum("weight")).first()
    level = (F.lit(words) - F.col("_before_full")).cast("double") / (F.lit(weights) - F.col("_before_weight"))
    first = line.withColumn("level", level).filter("level <= full_at").agg(F.min(F.struct("by_fill", "level"))["level"]).first()[0]
    return line.withColumn("target", F.least(F.col("full").cast("double"), F.lit(first or 0.0) * F.col("weight"))).select("_src", "size", "rank", "weight", "target")


def _draw(q: str, n: str, total: str, u: str) -> str:
    """SQL: how many of q things are among n drawn of total, all double, from a uniform u.

    Probabilities are taken relative to the mode's, outcomes from the mode upwards and then downwards: products and
    quotients alone, so that any engine gets the same bits.
    """
    lo, hi = f"greatest(0D, {n} + {q} - {total})", f"least({q}, {n})"
    mode = f"CAST(greatest({lo}, least({hi}, floor(({n} + 1D) * ({q} + 1D) / ({total} + 2D)))) AS BIGINT)"
    each = f"concat(sequence({mode}, CAST({hi} AS BIGINT)), CASE WHEN {mode} > {lo} THEN sequence({mode} - 1L, CAST({lo} AS BIGINT), -1L) ELSE CAST(array() AS ARRAY<BIGINT>) END)"
    up = f"(({q} - k + 1D) * ({n} - k + 1D)) / (k * ({total} - {q} - {n} + k))"
    down = f"((k + 1D) * ({total} - {q} - {n} + k + 1D)) / (({q} - k) * ({n} - k))"
    weight = f"CASE WHEN k = {mode} THEN 1D WHEN k > {mode} THEN s.w * ({up}) WHEN k = {mode} - 1 THEN {down} ELSE s.w * ({down}) END"
    mass = f"aggregate({each}, named_struct('w', 0D, 's', 0D), (s, k) -> named_struct('w', {weight}, 's', s.s + {weight}), s -> s.s)"
    # the state's mass is set first, by an aggregate over one number
    scan = f"""aggregate({each}, named_struct('w', 0D, 's', 0D, 'got', -1L),
        (s, k) -> named_struct('w', {weight}, 's', s.s + {weight}, 'got', CASE WHEN s.got < 0 AND s.s + {weight} >= {u} * m THEN k ELSE s.got END),
        s -> CASE WHEN s.got < 0 THEN {mode} ELSE s.got END)"""
    return f"aggregate(array({mass}), 0L, (none, m) -> {scan})"


def split(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """quotas (bundle, quota), BUNDLES rows at most, to rows (bundle, shard, quota): each of 2^depth shards' part, where it
    isn't 0.

    A node is one row that holds its quotas as an array. Children differ by one block at most in their totals.
    """
    u = f"((CAST(conv(substr(md5(concat('{seed}/', node, '/', x.bundle)), 1, 13), 16, 10) AS DOUBLE) + 0.5D) / 4503599627370496D)"
    draw = _draw("CAST(x.quota AS DOUBLE)", "CAST(a.n AS DOUBLE)", "CAST(a.total AS DOUBLE)", u)
    left = f"""aggregate(quotas, named_struct('n', total div 2, 'total', total, 'out', CAST(array() AS ARRAY<BIGINT>)),
        (a, x) -> aggregate(array({draw}), a, (b, d) -> named_struct('n', b.n - d, 'total', b.total - x.quota, 'out', concat(b.out, array(d)))),
        a -> a.out)"""
    halves = "zip_with(quotas, l, (x, d) -> named_struct('bundle', x.bundle, 'quota', {0}))"
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("bundle", "quota"))).alias("quotas")).select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(depth):
        drawn = nodes.withColumn("total", F.expr("aggregate(quotas, 0L, (a, x) -> a + x.quota)")).withColumn("l", F.explode(F.expr(f"array({left})")))
        nodes = drawn.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.expr(halves.format("d")).alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr(halves.format("x.quota - d")).alias("quotas")))).alias("x")).select("x.*")
        if level % 3 == 2:
            nodes = materialize(nodes, "tree")
    flat = nodes.select((F.col("node") - (1 << depth)).cast("int").alias("shard"), F.explode("quotas").alias("q"))
    return flat.select("q.bundle", "shard", "q.quota").filter("quota > 0")


def _repeated(df: DataFrame, times: str, name: str) -> DataFrame:
    """df's rows as often as their column times says, at least once, numbered from 1."""
    step = 1 << 15
    many = df.withColumn("_o", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {step})")))
    return many.withColumn(name, F.explode(F.expr(f"sequence(_o * {step} + 1, least({times}, (_o + 1) * {step}))"))).drop("_o")


class Mix:
    """The plan of a mix over docs: per source its size, target, whole passes and where its last pass ends; per block the
    shards its tickets went to."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ceiling: int = CEILING, shards: int | None = None, seed: int = SEED):
        self.docs, self.seed, self.names = docs, seed, (id_col, text_col, source_col)
        narrow = materialize(_keyed(docs, *self.names, seed, False), "mix")
        words = narrow.agg(F.sum("_size")).first()[0] or 0
        self.depth = max(0, ((shards or max(SHARDS, -(-words // SHARD_WORDS))) - 1).bit_length())
        self.block = F.shiftright("_key", KEY_BITS - min(30, self.depth + SHARD_BLOCK_BITS)).cast("int")
        self.narrow = narrow.withColumn("_block", self.block)
        blocks = materialize(self.narrow.groupBy("_src", "_block").agg(F.sum("_size").alias("words")), "blocks")
        quota = targets(materialize(blocks.groupBy("_src").agg(F.sum("words").alias("size")), "sizes"), ceiling)
        quota = quota.withColumn("passes", F.expr("CASE WHEN size > 0 THEN CAST(floor(target / size) AS BIGINT) ELSE 0L END"))
        quota = materialize(quota.withColumn("rest", F.expr("target - passes * size")), "quota")
        # the block in which the last pass ends
        run = W.partitionBy("_src").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
        ranged = blocks.withColumn("upto", F.sum("words").over(run)).join(bounded(quota), "_src")
        edge = materialize(ranged.filter("rest > 0 AND upto > rest AND upto - words <= rest").select("_src", F.col("_block").alias("edge"), "rest", (F.col("upto") - F.col("words")).alias("before")), "edge")
        # in it, documents are in while that brings the words nearer to the target; of equal rows so many are as do
        inside = W.partitionBy("_src").orderBy("_key", "doc_id", "_size", "_hash").rowsBetween(W.unboundedPreceding, -1)
        alike = self.narrow.join(bounded(edge), "_src").filter("_block = edge").groupBy("_src", "_block", "_key", "_hash").agg(F.first("doc_id").alias("doc_id"), F.first("_size").alias("_size"), F.first("rest").alias("rest"), F.first("before").alias("before"), F.count(F.lit(1)).alias("n"))
        begun = alike.withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("_size")).over(inside), F.lit(0)))
        last = "CASE WHEN _size = 0 THEN CASE WHEN before <= rest THEN n ELSE 0L END ELSE least(n, greatest(0L, CAST(floor((rest - before) / _size + 0.5D) AS BIGINT))) END"
        self.edges = materialize(begun.withColumn("last", F.expr(last)).select("_src", "_block", "_key", "_hash", "doc_id", "_size", "n", "last"), "edges")
        self.sources = materialize(quota.join(bounded(edge.select("_src", "edge")), "_src", "left").withColumn("edge", F.coalesce("edge", F.lit(-1))), "sources")
        # a ticket is one pass over one block
        drawn = blocks.join(bounded(self.sources), "_src").select("_src", "_block", (F.col("rank") % BUNDLES).alias("bundle"), F.expr("passes + CASE WHEN _block <= edge THEN 1 ELSE 0 END").alias("copies")).filter("copies > 0")
        each = drawn.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("_at", F.md5(F.concat_ws("/", F.lit(str(seed)), "_src", "_block", "copy"))).drop("copies")
        each = materialize(each, "drawn")
        quotas = split(each.groupBy("bundle").agg(F.count(F.lit(1)).alias("quota")), self.depth, seed)
        # a bundle's permuted tickets are ranked within slots of the hash, which are counted first
        each = each.withColumn("slot", F.substring("_at", 1, 2))
        ahead = W.partitionBy("bundle").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
        slots = each.groupBy("bundle", "slot").agg(F.count(F.lit(1)).alias("n")).select("bundle", "slot", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))  # 256 a bundle
        own = W.partitionBy("bundle", "slot").orderBy("_at", "_src", "_block", "copy")
        ranked = each.join(F.broadcast(slots), ["bundle", "slot"]).withColumn("r", F.col("first") + F.row_number().over(own) - 1)
        taken = W.partitionBy("bundle").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
        places = quotas.withColumn("first", F.coalesce(F.sum("quota").over(taken), F.lit(0))).select("bundle", "shard", F.explode(F.expr("sequence(first, first + quota - 1)")).alias("r"))
        dealt = ranked.join(places, ["bundle", "r"])
        self.tickets = materialize(dealt.groupBy("_src", "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards")), "tickets")

    def digest(self) -> DataFrame:
        """A row for each document: (doc_id, size, source_size, target, taken, shards), shards naming, comma-joined and sorted,
        the shard of each time it is taken; taken is what these come to."""
        figures = bounded(self.sources.select("_src", F.col("size").alias("source_size"), "target", "passes", "edge"))
        tickets = bounded(self.tickets)
        full = self.narrow.join(figures, "_src").filter("_block <> edge").join(tickets, ["_src", "_block"], "left")
        part = _repeated(self.edges, "n", "nth").join(figures, "_src").join(tickets, ["_src", "_block"], "left")
        part = part.withColumn("shards", F.expr("CASE WHEN nth <= last THEN shards ELSE slice(shards, 1, CAST(passes AS INT)) END"))
        names = ("doc_id", "_size", "source_size", "target", "shards")
        found = full.select(*names).unionByName(part.select(*names))
        return found.select(
            "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.coalesce(F.size("shards"), F.lit(0)).cast("long") * F.col("_size")).alias("taken"),
            F.coalesce(F.array_join(F.array_sort("shards"), ","), F.lit("")).alias("shards"),
        )

    def rows(self) -> DataFrame:
        """docs, as one column row, once for each time it is taken, with columns copy (from 0) and shard: a partition is a
        shard, in its own random order."""
        keyed = _keyed(self.docs, *self.names, self.seed, True).withColumn("_block", self.block)
        figures, tickets = bounded(self.sources.select("_src", "passes")), bounded(self.tickets)
        edges = self.edges.select("_src", "_key", "_hash", "n", "last")
        found = keyed.join(tickets, ["_src", "_block"]).join(figures, "_src").join(bounded(edges), ["_src", "_key", "_hash"], "left")
        whole_passes = "slice(shards, 1, CAST(passes AS INT))"
        each = found.select("row", "_key", F.posexplode(F.expr(f"CASE WHEN n IS NULL OR n = 1 AND last = 1 THEN shards ELSE {whole_passes} END")).alias("copy", "shard"))
        several = materialize(edges.filter("n > 1 AND last > 0"), "several")
        if not several.isEmpty():  # equal rows of which the last pass takes some: which ones makes no difference
            one = keyed.join(bounded(several), ["_src", "_key", "_hash"]).groupBy("_src", "_block", "_key", "_hash").agg(F.first("row").alias("row"), F.first("last").alias("last"))
            more = _repeated(one, "last", "nth").join(tickets, ["_src", "_block"]).select("row", "_key", (F.size("shards") - 1).alias("copy"), F.element_at("shards", -1).alias("shard"))
            each = each.unionByName(more)
        order = F.xxhash64(F.lit(self.seed), "_key", "copy")
        return each.repartitionById(1 << self.depth, "shard").sortWithinPartitions("shard", order).drop("_key")


def query(docs: DataFrame) -> DataFrame:
    """One row for each row of docs. Null text: size 0. A null source is a source, the last. Rows that repeat a doc_id, null
    ones too, are documents of their own; of rows that are alike in all, the last pass takes as many as the target needs.
    A text counts by its words however long it is. Columns besides id, text and source only tell rows apart. No rows: no
    rows. A source without words has target 0 and takes nothing."""
    return Mix(docs).digest()


def resample(docs: DataFrame) -> DataFrame:
    """The mixed documents with docs' columns, whatever their names; a document taken twice is there twice, one that isn't
    taken is not. Nulls, repeated rows and empty tables as in query()."""
    return Mix(docs).rows().select("row.*")


def _sql() -> str:
    """For tables of at most SHARDS x SHARD_WORDS words and BUNDLES sources, above which there are more shards and blocks."""
    depth, bits = (SHARDS - 1).bit_length(), (SHARDS - 1).bit_length() + SHARD_BLOCK_BITS
    u = f"((('0x' || substr(md5('{SEED}/' || node || '/' || x.bundle), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
    q, n, total = "x.q", "a.n", "a.total"
    lo, hi = f"greatest(0::DOUBLE, {n} + {q} - {total})", f"least({q}, {n})"
    mode = f"greatest({lo}, least({hi}, floor(({n} + 1) * ({q} + 1) / ({total} + 2))))::BIGINT"
    # reduced lists hold values of one type, the state's
    each = f"list_transform(list_concat(range({mode}, ({hi})::BIGINT + 1), range({mode} - 1, ({lo})::BIGINT - 1, -1)), lambda k: {{'k': k::DOUBLE, 'w': 0::DOUBLE, 's': 0::DOUBLE, 'got': -1::BIGINT}})"
    up = f"(({q} - e.k + 1) * ({n} - e.k + 1)) / (e.k * ({total} - {q} - {n} + e.k))"
    down = f"((e.k + 1) * ({total} - {q} - {n} + e.k + 1)) / (({q} - e.k) * ({n} - e.k))"
    weight = f"CASE WHEN e.k = {mode} THEN 1::DOUBLE WHEN e.k > {mode} THEN s.w * ({up}) WHEN e.k = {mode} - 1 THEN {down} ELSE s.w * ({down}) END"
    start = "{'k': 0::DOUBLE, 'w': 0::DOUBLE, 's': 0::DOUBLE, 'got': -1::BIGINT}"
    mass = f"list_reduce({each}, lambda s, e: {{'k': e.k, 'w': {weight}, 's': s.s + {weight}, 'got': -1::BIGINT}}, {start}).s"
    scan = f"list_reduce({each}, lambda s, e: {{'k': e.k, 'w': {weight}, 's': s.s + {weight}, 'got': CASE WHEN s.got < 0 AND s.s + {weight} >= {u} * {mass} THEN e.k::BIGINT ELSE s.got END}}, {start}).got"
    d = f"(CASE WHEN {scan} < 0 THEN {mode} ELSE {scan} END)"
    state = "{{'bundle': {0}, 'q': {1}::DOUBLE, 'n': {2}, 'total': {3}, 'out': {4}::BIGINT[]}}"
    items = f"list_transform(quotas, lambda z: {state.format('z.bundle', 'z.quota', '0::DOUBLE', '0::DOUBLE', '[]')})"
    # one draw's text occurs once: the next state is made of the list it is appended to
    step = f"list_transform([{d}], lambda g: {state.format('x.bundle', 'x.q', 'a.n - g', 'a.total - x.q', 'list_append(a.out, g)')})[1]"
    left = f"list_reduce({items}, lambda a, x: {step}, {state.format('0::BIGINT', '0', '(total // 2)::DOUBLE', 'total::DOUBLE', '[]')}).out"
    half = "list_transform(range(1, len(quotas) + 1), lambda i: {{'bundle': quotas[i].bundle, 'quota': {0}}})"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, coalesce('=' || source, '') AS src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src = '', src) - 1 AS rank FROM d GROUP BY src),
f AS (SELECT *, rank % 3 + 1 AS w, ({CEILING} * source_size)::DOUBLE / (rank % 3 + 1) AS full_at FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({CEILING} * source_size) OVER (ORDER BY full_at, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY full_at, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM f),
t AS (SELECT src, source_size, rank, least(({CEILING} * source_size)::DOUBLE, w * coalesce((SELECT arg_min(level, (full_at, src)) FROM l WHERE level <= full_at), 0)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
r AS (SELECT *, target - passes * source_size AS rest FROM q),
c AS (SELECT d.doc_id, d.size, k >> {KEY_BITS - bits} AS block, r.*, sum(d.size) OVER (PARTITION BY src ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN r USING (src)),
b AS (SELECT src, block, rank, passes, rest, sum(size) AS words FROM c GROUP BY ALL),
g AS (SELECT *, sum(words) OVER (PARTITION BY src ORDER BY block ROWS UNBOUNDED PRECEDING) AS upto FROM b),
e AS (SELECT src, block AS edge FROM g WHERE rest > 0 AND upto > rest AND upto - words <= rest),
tickets AS MATERIALIZED (SELECT g.src, block, rank % {BUNDLES} AS bundle, unnest(range(passes + CASE WHEN block <= coalesce(edge, -1) THEN 1 ELSE 0 END)) AS copy FROM g LEFT JOIN e USING (src)),
tree(level, node, quotas) AS (
    SELECT 0, 1::BIGINT, list({{'bundle': bundle, 'quota': quota}} ORDER BY bundle) FROM (SELECT bundle, count(*)::BIGINT AS quota FROM tickets GROUP BY bundle)
    UNION ALL
    SELECT level + 1, 2 * node + side, CASE WHEN side = 0 THEN {half.format('l[i]')} ELSE {half.format('quotas[i].quota - l[i]')} END
    FROM (SELECT level, node, quotas, {left} AS l FROM (SELECT *, list_sum(list_transform(quotas, lambda z: z.quota))::BIGINT AS total FROM tree WHERE level < {depth})), (VALUES (0), (1)) v(side)),
leaf AS (SELECT node - {1 << depth} AS shard, unnest(quotas, max_depth := 1) AS x FROM tree WHERE level = {depth}),
places AS (SELECT shard, x.bundle AS bundle, sum(x.quota) OVER (PARTITION BY x.bundle ORDER BY shard ROWS UNBOUNDED PRECEDING) - x.quota AS first, x.quota AS quota FROM leaf WHERE x.quota > 0),
place AS (SELECT bundle, shard, unnest(range(first::BIGINT, (first + quota)::BIGINT)) AS r FROM places),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY md5('{SEED}/' || src || '/' || block || '/' || copy), src, block, copy) - 1 AS r FROM tickets),
dealt AS (SELECT src, block, list(shard ORDER BY copy) AS shards FROM ranked JOIN place USING (bundle, r) GROUP BY src, block),
found AS (SELECT c.doc_id, c.size, c.source_size, c.target,
    CASE WHEN c.block = coalesce(e.edge, -1) AND NOT (c.upto - c.size / 2.0 <= c.rest) THEN shards[1:c.passes] ELSE shards END AS shards
    FROM c LEFT JOIN e USING (src) LEFT JOIN dealt ON dealt.src = c.src AND dealt.block = c.block)
SELECT doc_id, size, source_size, target, (size * coalesce(len(shards), 0))::BIGINT AS taken, coalesce(array_to_string(list_sort(shards), ','), '') AS shards FROM found
"""


SQL = _sql()
