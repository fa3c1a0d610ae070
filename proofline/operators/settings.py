"""Limits of a profile as columns: one profile for all documents, or a profile row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a profile can say, as nested columns. NULL leaves a value to the default, or a limit open.
PROFILE_TYPE = (
    "title struct<max_chars:int>, short_title struct<max_chars:int,counts_spaces:boolean>, keywords struct<min:int,max:int>, "
    "abstract struct<max_words:int,format:string,forbid:array<string>>, word_limit struct<max:int,severity:string>, "
    "figures struct<recommended_max:int>, references struct<recommended_max:int>, declarations struct<order:array<string>>, "
    "statistics struct<p_style:string,q_style:string,n_style:string,pm_style:string,p_italic:boolean>, language struct<spelling:string>, "
    "formatting struct<language:array<string>,default_lang:string,references_line_spacing:string>, "
    "lint struct<disabled_rules:array<string>,universal_abbreviations:array<string>>")
#: The parts that rules compare with a document's measures, by column; the others are conventions of notation.
CONVENTIONS = ("statistics", "language", "formatting", "lint.universal_abbreviations")
_TYPES = {"format": "string", "severity": "string", "forbid": "array<string>", "order": "array<string>", "disabled_rules": "array<string>", "counts_spaces": "boolean"}


class DocumentProfiles(dict):
    """Profiles by document, ``frame(doc_id, profile struct)``; as a dict it gives the conventions that its documents share."""

    def __init__(self, conventions: dict, frame: DataFrame):
        super().__init__(conventions)
        self.frame = frame


def _literal(value, kind: str) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(str(x)) for x in value]).cast(kind)
    return F.lit(value).cast(kind)


def with_settings(df: DataFrame, profile: dict, **paths: str) -> DataFrame:
    """``df`` with a column for each ``name="part.value"`` of the document's profile; NULL where it says nothing."""
    if isinstance(profile, DocumentProfiles):
        own = profile.frame.select("doc_id", *[F.col(f"profile.{path}").alias(name) for name, path in paths.items()])
        return df.join(own, "doc_id", "left")
    found = {}
    for name, path in paths.items():
        part, _, key = path.partition(".")
        found[name] = _literal((profile.get(part) or {}).get(key), _TYPES.get(key, "int"))
    return df.withColumns(found)
