"""JSON in free text, and JSON paths, by the variant type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(text: Column) -> Column:
    """The variant of a text that is JSON and nothing else, else null. (The parser stops after the first value; inside brackets of either kind it can't.)"""
    in_list, in_object = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def salvaged(text: Column, default: str = "{}") -> Column:
    """The JSON of an answer, as a variant: the whole text, else from its first brace to its last, else the first fenced block, else ``default``.

    A null text gives the default. Objects that name a member twice are no JSON here.
    """
    tries = [text, F.regexp_extract(text, r"\{[\s\S]*\}", 0), F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)]
    return F.coalesce(*(strict(t) for t in tries), F.parse_json(F.lit(default)))


def answer(text: Column) -> Column:
    """score, confidence, explanation, risks, strengths of a scored answer with the defaults of what is missing; what can't be read scores 0 and is kept as raw."""
    fenced = F.when(F.contains(text, F.lit("```json")), F.split_part(F.split_part(text, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))).when(F.contains(text, F.lit("```")), F.split_part(text, F.lit("```"), F.lit(2))).otherwise(text)
    data = strict(fenced)
    # only an object has members
    data = F.when(F.schema_of_variant(data).startswith("OBJECT"), data)
    get = lambda path, kind: F.try_variant_get(data, f"$.{path}", kind)
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(get("score", "double"), F.lit(0.0)).alias("score"), F.coalesce(get("confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.when(data.isNull(), "Failed to parse AI response.").otherwise(F.coalesce(get("explanation", "string"), F.lit("No explanation provided."))).alias("explanation"),
        F.coalesce(get("risks", "array<string>"), none).alias("risks"), F.coalesce(get("strengths", "array<string>"), none).alias("strengths"), F.when(data.isNull(), text).alias("raw"),
    )


def at_path(json: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of JSON text, null where it is missing or of another kind."""
    return F.try_variant_get(strict(json), path, kind)
