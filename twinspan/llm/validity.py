"""Source files that do not parse, per file and as rates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.llm.syntax.check import LANGUAGES, problem
from twinspan.session import spread


def file_validity(df: DataFrame, doc_id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """``doc_id, repo, language, kind, line`` of every source file with a text.

    ``kind`` says why a file does not parse (see syntax.check.problem) and is
    null for a valid one; ``line`` is where. Language and repository follow
    from the path. Defined cases: null texts, null paths and other extensions
    have no row; blank code is valid, blank JSON is not; repeated rows are
    judged each; other columns are not read. No shuffle.
    """
    ext = F.regexp_extract(F.col("path"), r"[^/]\.(rs|py|tsx?|js|json)$", 1)
    files = df.select(df[doc_id].alias("doc_id"), df[path].alias("path"), df[text].alias("text")).withColumn("ext", ext).filter("ext <> '' AND text IS NOT NULL")
    files = files.select("doc_id", F.substring_index("path", "/", 1).alias("repo"), "ext", "text")
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, lines, languages = [], [], []
            for ext, text in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                t = text.as_py()
                found = problem(t, ext)
                languages.append(LANGUAGES[ext])
                kinds.append(found and found[0])
                lines.append(t.count("\n", 0, max(0, found[1])) + 1 if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(kinds, pa.string()), pa.array(lines, pa.int32())],
                names=["doc_id", "repo", "language", "kind", "line"],
            )

    return spread(files).mapInArrow(run, f"doc_id {kind}, repo string, language string, kind string, line int")


def invalid_rates(checked: DataFrame) -> DataFrame:
    """``repo, language, files, invalid, rate`` and a count per kind of fault."""
    kinds = ["merge_conflict_marker", "unterminated_literal", "premature_end", "unbalanced_delimiter", "unexpected_token", "nesting_too_deep"]
    return checked.groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count("kind").alias("invalid"), (F.count("kind") / F.count("*")).alias("rate"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    )
