"""Text, NDJSON, SARIF and prompt renderings of groups, one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions.labels import hex16
from twinspan.functions.paths import posix_path


def _spans(occurrences: Column | str, prefix: str = "") -> Column:
    return F.transform(occurrences, lambda o: F.concat(F.lit(prefix), posix_path(o["path"]), F.lit(":"), o["start_line"].cast("string"), F.lit("-"), o["end_line"].cast("string")))


def group_text(details: DataFrame, number: str = "id") -> DataFrame:
    """Header with the stored count, then path:start-end lines."""
    head = F.concat(F.lit("--- ["), "tier", F.lit("] group "), F.col(number).cast("string"), F.lit(" ("), F.coalesce(F.col("occurrence_count").cast("string"), F.lit("0")), F.lit(" occurrences) ---"))
    return details.select("id", F.concat_ws("\n", F.array(head), _spans("occurrences")).alias("text"))


def group_json(details: DataFrame, number: str = "ordinal") -> DataFrame:
    """NDJSON line; a null id and null bytes are left out."""
    occ = F.transform("occurrences", lambda o: F.struct(posix_path(o["path"]).alias("path"), o["start_line"].alias("start_line"), o["end_line"].alias("end_line"), o["start_byte"].alias("start_byte"), o["end_byte"].alias("end_byte")))
    row = F.struct("id", F.col(number).alias("ordinal"), "tier", hex16(F.col("group_hash")).alias("hash"), "occurrence_count", occ.alias("occurrences"))
    return details.select("id", F.to_json(row).alias("json"))


def sarif_result(details: DataFrame) -> DataFrame:
    """SARIF 2.1.0 result of each group; lines are clamped to the schema."""

    def location(o: Column) -> Column:
        start = F.greatest(o["start_line"], F.lit(1))
        region = F.struct(start.alias("startLine"), F.greatest(o["end_line"], start).alias("endLine"))
        return F.struct(F.struct(F.struct(posix_path(o["path"]).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))

    message = F.concat(F.lit("Duplicate block ("), F.coalesce(F.col("occurrence_count"), F.lit(0)).cast("string"), F.lit(" occurrences, Tier "), "tier", F.lit(")"))
    row = F.struct(
        F.lit("duplicate-block").alias("ruleId"),
        F.lit("note").alias("level"),
        F.struct(message.alias("text")).alias("message"),
        F.struct(F.coalesce(hex16(F.col("group_hash")), F.concat(F.lit("id-"), F.col("id").cast("string"))).alias("groupHash/v1")).alias("partialFingerprints"),
        F.transform("occurrences", location).alias("locations"),
    )
    return details.select("id", F.to_json(row).alias("result"))


#: The rule id (above: the fingerprint key) that readers of the log match on.
SARIF_HEAD = (
    '{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"twinspan","version":"0.1.0",'
    '"rules":[{"id":"duplicate-block","name":"DuplicateBlock","shortDescription":{"text":"The same code stands in several places"},'
    '"fullDescription":{"text":"These lines say the same as the other locations of this result, word for word or up to names."},"defaultConfiguration":{"level":"note"}}]}},"results":['
)
SARIF_TAIL = "]}]}"


def suppression_json(suppressions: DataFrame) -> DataFrame:
    return suppressions.select("group_hash", F.to_json(F.struct(hex16(F.col("group_hash")).alias("hash"), "dismissed_at", "last_group_id")).alias("json"))


#: What a request says around the number and language of the places.
PROMPT_HEAD = "The same code was found in "
PROMPT_TAIL = "places, listed below. Open each of them and suggest how the repetition can be removed, for instance by one shared function, type or constant; weigh what that would cost."


def prompt(details: DataFrame) -> DataFrame:
    """A request to refactor each group, for pasting into an assistant; empty without occurrences."""
    lang = F.coalesce(F.concat("language", F.lit(" ")), F.lit(""))
    head = F.concat(F.lit(PROMPT_HEAD), F.size("occurrences").cast("string"), F.lit(" "), lang, F.lit(PROMPT_TAIL + "\n\n"))
    body = F.concat(F.array_join(_spans("occurrences", "- "), "\n"), F.lit("\n"))
    return details.select("id", F.when(F.size("occurrences") == 0, "").otherwise(F.concat(head, body)).alias("prompt"))
