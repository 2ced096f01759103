"""Explicit schemas of the engine tables."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("line", "column", "endLine", "endColumn", "offset", "length")]
)

FIX = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("replacement", T.StringType()),
        T.StructField("replaceSpan", SPAN),
        T.StructField("confidence", T.StringType()),
    ]
)

VIOLATION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("fix", FIX),
        T.StructField("ruleId", T.StringType()),
        T.StructField("span", SPAN),
        T.StructField("codeSnippet", T.StringType()),
        T.StructField("priorityScore", T.DoubleType()),
    ]
)

DEPENDENCY = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("linesOfCode", T.IntegerType()),
        T.StructField("cyclomaticComplexity", T.IntegerType()),
        T.StructField("numberOfMethods", T.IntegerType()),
        T.StructField("numberOfClasses", T.IntegerType()),
        T.StructField("importCount", T.IntegerType()),
        T.StructField("coveragePercent", T.DoubleType()),
    ]
)

BREAKDOWN = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("deduction", T.DoubleType()),
        T.StructField("detail", T.StringType()),
    ]
)

ANALYSIS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("dependencies", T.ArrayType(DEPENDENCY)),
        T.StructField("metrics", METRICS),
        T.StructField("violations", T.ArrayType(VIOLATION)),
        T.StructField("rating", T.DoubleType()),
        T.StructField("analyzedAt", T.TimestampType()),
        T.StructField("definedTypes", T.ArrayType(T.StringType())),
        T.StructField("ratingBreakdown", T.ArrayType(BREAKDOWN)),
        T.StructField("fileHash", T.StringType()),
        T.StructField("analyzerVersion", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

# JSON blobs carry `analyzedAt` as epoch milliseconds and `fix` as a string or an object, so the
# raw form reads both as they come and sources.tables.from_blob normalises them.
RAW_VIOLATION = T.StructType([T.StructField("fix", T.StringType()) if f.name == "fix" else f for f in VIOLATION])
_RAW_TYPES = {
    "analyzedAt": T.LongType(),
    "violations": T.ArrayType(RAW_VIOLATION),
}
RAW_ANALYSIS = T.StructType(
    [T.StructField(f.name, _RAW_TYPES.get(f.name, f.dataType)) for f in ANALYSIS if f.name not in ("repo", "seq")]
    + [T.StructField("repoRoot", T.StringType())]
)

NODE = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("loc", T.IntegerType()),
        T.StructField("complexity", T.IntegerType()),
        T.StructField("imports", T.IntegerType()),
        T.StructField("n_violations", T.IntegerType()),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("strength", T.DoubleType()),
    ]
)

GRAPH_DOCUMENT = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("generatedAt", T.LongType()),
        T.StructField("repo", T.StringType()),
        T.StructField("overallRating", T.DoubleType()),
        T.StructField(
            "nodes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("label", T.StringType()),
                        T.StructField("rating", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "edges",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source", T.StringType()),
                        T.StructField("target", T.StringType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("weight", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "repos",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("path", T.StringType()),
                        T.StructField("label", T.StringType()),
                        T.StructField("lastIndexedAt", T.LongType()),
                        T.StructField("nodeCount", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

CHANGE = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

PUSH_PAYLOAD = T.StructType(
    [
        T.StructField("ref", T.StringType()),
        T.StructField(
            "repository",
            T.StructType([T.StructField("owner", T.StringType()), T.StructField("name", T.StringType())]),
        ),
        T.StructField("pusher", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField(
            "commits",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("modified", T.ArrayType(T.StringType())),
                        T.StructField("added", T.ArrayType(T.StringType())),
                        T.StructField("removed", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)
