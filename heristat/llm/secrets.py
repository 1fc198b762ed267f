"""Secret scanning with corpus-wide ownership frequency.

Base matches are fixed patterns. Beside them the scan proposes credential-like strings (long, mixed characters, high
entropy) that no pattern names. Every string's hash is counted over distinct repositories and owners in the whole
corpus: one that many owners, or very many repositories, hold is an example copied around, one that a single owner holds
in a few looks live. The latter are added as spans of kind "owned", and every span is said to be live or copied.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from heristat.llm.common import materialize, quoted, slices, spread_join, whole

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is too short holds no longer one
HEX = re.compile(r"[0-9a-f]{16,}")
LOOSE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN = 12
#: A loose string needs a digit, a letter, and this many bits of entropy a character.
MIN_BITS = 3.0
#: Strings that at most so many owners and repositories hold look live; beyond, they are copied examples.
MAX_OWNERS, MAX_REPOS = 1, 20

SPAN = "struct<kind:int,start:int,end:int,value:bigint>"


def _value(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 0) - (1 << 63)


def _looks_random(text: str) -> bool:
    n = len(text)
    if not any(c.isdigit() for c in text) or not any(c.isalpha() for c in text):
        return False
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) >= MIN_BITS


def scan_text(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, hash of the secret itself), base kinds first; loose strings inside none of them last."""
    found = []
    low = text.lower()  # only to rule texts out; offsets come from the text itself
    if any(h in low for h in HINTS):
        found += [(0, m.start(), m.end(), _value(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), _value(m[0])) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), _value(m[0])) for m in HEX.finditer(text)]
    covered = sorted((s, e) for _, s, e, _ in found)
    at = reach = 0
    for m in LOOSE.finditer(text):
        s, e = m.span()
        while at < len(covered) and covered[at][0] < e:
            reach = max(reach, covered[at][1])
            at += 1
        if reach <= s and _looks_random(m[0]):
            found.append((3, s, e, _value(m[0])))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "value")
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))
    for part in slices(batches, "text", 8 << 20):
        rows = [[dict(zip(names, x)) for x in scan_text(t or "")] for t in part.column("text").to_pylist()]
        keep = [n for n in part.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(rows, kind)], [*keep, "spans"])


def _strings(spans: str) -> str:
    """SQL: kind:start:end of spans by start, then kind, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"""array_join(transform(array_sort(transform({spans}, x -> struct(x.start, x.kind, x.end))),
        x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Rows (doc_id, text_key, spans), one per input row: spans array<struct<kind, start, end, value, owners, repos, live>>,
    kind an index into KINDS, offsets in code points, owners and repos the distinct ones that hold the string, live whether
    these are at most max_owners and max_repos; text_key = xxhash64(text).

    Null text counts as empty; a text of any length is scanned whole. Null owners (repositories) count as one owner
    (repository) of that name. A base span stays whatever its frequency; a loose one only if it is live. Repeated rows are each
    returned. No rows: no rows. Other columns don't count. Triples of value, owner and repository are made distinct first,
    pre-aggregated in the map tasks; values that very many documents hold are joined back by a broadcast.
    """
    text = F.col(quoted(text_col)).cast("string")
    narrow = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(owner_col)).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(quoted(repo_col)).cast("string"), F.lit("")).alias("repo"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
    )
    kinds = dict(narrow.dtypes)
    scanned = narrow.mapInArrow(_scan, f"doc_id {kinds['doc_id']}, owner string, repo string, text_key bigint, spans array<{SPAN}>")
    rows = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "spans")
    each = rows.select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    held = materialize(each.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n")), "held")
    distinct = lambda c: held.groupBy("value", c).agg(F.sum("n").alias("n")).groupBy("value").agg(F.count(F.lit(1)).alias(f"{c}s"), F.sum("n").alias("n"))
    seen = materialize(distinct("owner").join(distinct("repo").drop("n"), "value"), "seen")
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = spread_join(each, seen, "value", "n").withColumn("live", live).filter("kind < 3 OR live")
    per_row = judged.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "value", "owners", "repos", "live")).alias("spans"))
    return rows.drop("spans", "owner", "repo").join(per_row, "row", "left").select("doc_id", "text_key", F.coalesce("spans", F.expr("array()")).alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    """The digest of every row's spans; verdicts says for each span, in spans' order, whether it looks live or copied, and how
    many owners and repositories hold its string. The tables have no repositories: a document counts as one, a source as
    its owner."""
    found = scan(docs)
    count = lambda k: F.expr(f"CAST(size(filter(spans, x -> x.kind = {k})) AS BIGINT)")
    verdicts = "array_join(transform(array_sort(transform(spans, x -> struct(x.start, x.kind, x.end, x.live, x.owners, x.repos))), x -> concat(CASE WHEN x.live THEN 'live' ELSE 'copied' END, ':', x.owners, ':', x.repos)), ',')"
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_strings("filter(spans, x -> x.kind < 3)")), 256).alias("base_sha256"), F.expr(_strings("spans")).alias("spans"),
        count(3).alias("n_owned"), F.expr("CAST(size(filter(spans, x -> x.live)) AS BIGINT)").alias("n_live"), F.expr(verdicts).alias("verdicts"),
    )


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            out, at = [], 0
            for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                if s >= at:
                    out += [text[at:s], "[secret]"]
                at = max(at, e)
            texts.append("".join(out) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of scan() replaced by "[secret]" and n_chars, where there is one, brought up to date. All rows stay,
    null and empty texts as they are. No rows: no rows. Other columns, whatever their names, stay.

    Spans are joined back by doc_id and text, so rows that share a doc_id are told apart.
    """
    spans = scan(docs).filter("size(spans) > 0").select(F.col("doc_id").alias("id"), "text_key", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    spans = spans.groupBy("id", "text_key").agg(F.min("spans").alias("spans"))  # repeated rows have equal spans
    own = docs.select(whole(docs).alias("row"), F.col("doc_id").alias("own"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    joined = own.join(spans, F.col("own").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left").select("row", "text", "spans")
    hit = joined.filter("spans IS NOT NULL").mapInArrow(_redact, StructType([joined.schema["row"], StructField("text", StringType())]))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return joined.filter("spans IS NULL").select("row.*").unionByName(hit.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)))
