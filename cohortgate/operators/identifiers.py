"""Identifier scan over free text and over JSON text of any shape."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortgate.fixed_values import DIGEST_KEYS, FORBIDDEN_KEYS
from cohortgate.policy import Deployment

# One JSON token: a string, with the colon behind it when it is a key, a bracket, or a bare value.
_TOKEN = r'"[^"\\]*+(?:(?s:\\.)[^"\\]*+)*+"(?:\s*:)?|[{}\[\]]|[^\s"{}\[\],:]+'


def value_patterns(deployment: Deployment) -> dict[str, str]:
    """Pseudonym, participant id and ten-digit health-number shapes.

    ``(?U)`` gives Unicode word boundaries and digits, so an accented neighbour is a letter.
    """
    pseudo = re.escape(deployment.pseudo_prefix)
    person = re.escape(deployment.participant_prefix)
    return {
        "pseudo_id": rf"(?iU)\b{pseudo}[0-9A-F]{{6,}}\b",
        "participant_id": rf"(?iU)\b{person}\d{{4,}}\b",
        "health_number": r"(?U)\b\d{3}\s?\d{3}\s?\d{4}\b",
    }


def has_identifier_text(text: Column, deployment: Deployment) -> Column:
    """Any of the three value shapes in a whole text."""
    found = F.lit(False)
    for pattern in value_patterns(deployment).values():
        found = found | text.rlike(pattern)
    return found


def identifier_hits(text: Column, deployment: Deployment) -> dict[str, Column]:
    """How often each shape occurs in a whole text."""
    return {
        name: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
        for name, pattern in value_patterns(deployment).items()
    }


def _text_of(body: Column) -> Column:
    """The text that a JSON string token (with its quotes) stands for."""
    decoded = F.get(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", {"allowUnescapedControlChars": "true"}), F.lit(0))
    bare = F.substring(body, F.lit(2), F.length(body) - 2)
    return F.when(body.contains("\\"), F.coalesce(decoded, bare)).otherwise(bare)


def has_forbidden_content(json_text: Column, deployment: Deployment) -> Column:
    """A forbidden key anywhere, or an identifier-shaped value outside the digest fields.

    Keys and values are decoded before they are matched, so an escape cannot hide one. The tokens
    are walked once with the nesting depth; all that a digest field holds, at any depth, is free
    of value checks but not of key checks.
    """

    def step(state: Column, token: Column) -> Column:
        is_text, is_key = token.startswith('"'), token.startswith('"') & token.endswith(":")
        text = _text_of(F.when(is_key, F.regexp_replace(token, r"\s*:$", "")).otherwise(token))
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth = state["depth"] + opens.cast("int") - closes.cast("int")
        skipping = state["skip"] >= 0
        skip = F.when(skipping & closes & (depth == state["skip"]), -1).when(
            ~skipping & state["digest"] & opens, state["depth"]
        ).otherwise(state["skip"])
        name = F.lower(text)
        bad_key = F.lit(False)
        for key in FORBIDDEN_KEYS:
            bad_key = bad_key | name.contains(key)
        bad_value = ~skipping & ~state["digest"] & has_identifier_text(text, deployment)
        found = F.when(is_key, bad_key).when(is_text, bad_value).otherwise(False)
        return F.struct(
            depth.alias("depth"), skip.alias("skip"),
            F.coalesce(~skipping & is_key & text.isin(DIGEST_KEYS), F.lit(False)).alias("digest"),
            (state["hit"] | F.coalesce(found, F.lit(False))).alias("hit"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(-1).alias("skip"), F.lit(False).alias("digest"), F.lit(False).alias("hit")
    )
    tokens = F.regexp_extract_all(json_text, F.lit(_TOKEN), F.lit(0))
    return F.coalesce(F.aggregate(tokens, start, step, lambda state: state["hit"]), F.lit(False))
