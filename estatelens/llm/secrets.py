"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger holds the pairs of
blob and rule version that have been scanned, with their findings. A scan reads the text of only those blobs whose
pair is not in the ledger yet, each once however many paths and versions share it, appends them, and joins the
findings back to all paths.

Java's regular expressions give matches but no positions, so the spans of a kind come from the matches and the pieces
between them: lengths in code points, summed up. The patterns of the base rules are applied as they are; length
limits are checked on the matches afterwards, so that a failing match still takes its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import only

#: Kind, pattern, group whose length counts, least length. In the order of kinds.
RULES = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: A pattern that every text with a kept match of the kind matches; it spares the others the splitting.
HINTS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
RULE_VERSION = "base-1"
_SPAN = "array<struct<start:long,end:long,kind:string>>"


def _kind_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind in code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.zip_with(F.split(text, pattern, -1), whole, lambda p, m: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m")))
    pieces = F.filter(pieces, lambda x: x.m.isNotNull())
    pieces = F.zip_with(pieces, judged, lambda x, j: F.struct(x.p.alias("p"), x.m.alias("m"), F.length(j).alias("j")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        begin = acc.at + x.p
        span = F.array(F.struct(begin.alias("start"), (begin + x.m).alias("end"), F.lit(kind).alias("kind")))
        return F.struct((begin + x.m).alias("at"), F.when(x.j >= least, F.concat(acc.out, span)).otherwise(acc.out).alias("out"))

    return F.when(text.rlike(HINTS[kind]), F.aggregate(pieces, start, step, lambda acc: acc.out)).otherwise(F.array().cast(_SPAN))


def spans_of(text: Column) -> Column:
    """All spans of a text by start, then by the order of the kinds."""
    rank = {kind: i for i, (kind, *_) in enumerate(RULES)}
    found = F.concat(*[_kind_spans(text, *rule) for rule in RULES])
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    keyed = F.transform(found, lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) of the blobs in ``versions(text)`` that this rule version has not scanned.

    The text of a blob is read once. Equal texts combine before the shuffle, so that a blob with very many copies
    sends one row for each task.
    """
    blobs = versions.where("text is not null").groupBy(blob_of(F.col("text")).alias("blob")).agg(F.any_value("text").alias("text"))
    if ledger is not None:
        done = ledger.where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(done, "blob", "left_anti")
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), spans_of(F.col("text")).alias("spans"))


def secret_scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of each row of ``versions(doc_id, text)``, and the ledger with the newly scanned blobs.

    The findings have (doc_id, blob, spans); a null text reads as empty and has none. Rows repeat as in the input,
    null doc_ids included. Other columns take no part. An empty table gives no rows and leaves the ledger as it is.
    """
    versions = only(versions, doc_id="long", text="string")
    fresh = materialize(scan_unseen(versions, ledger, rule_version), "ledger").df
    after = fresh if ledger is None else ledger.select(fresh.columns).union(fresh)
    found = after.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    paths = versions.select("doc_id", blob_of(F.coalesce("text", F.lit(""))).alias("blob"))
    spans = F.coalesce("spans", F.array().cast(_SPAN))
    return paths.join(found, "blob", "left").select("doc_id", "blob", spans.alias("spans")), after


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.array(F.substring(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, F.concat(acc.out, piece)).otherwise(acc.out).alias("out"))

    cut = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, (acc.at + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
