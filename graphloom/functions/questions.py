"""Questions in plain words to one of four intents, as a column or a value; what fits no rule is refused."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a target and a scope look like, what is trimmed from the end of questions and of targets, and phrasings in order, with the intent of each and what its group is.
_TARGET = r"""["']?([A-Za-z0-9_./@#:~-]+)["']?"""
_SCOPE = r"""(?:\s+in\s+["']?([A-Za-z0-9_./:-]+)["']?)?"""
QUESTION_END = r"[?.!,;:\s]+$"
VALUE_END = r"[.,;:!?]+$"
RULES = (
    (rf"(?:blast\s*radius(?:\s+of)?|impact\s+of\s+(?:changing|removing|deleting)|what\s+depends\s+on|who\s+calls|who\s+uses)\s+{_TARGET}\s*$", "blast-radius", "target"),
    (rf"\bis\s+{_TARGET}\s+(?:a\s+)?dead(?:\s+code)?\b", "dead-code-check", "target"),
    (rf"\bis\s+{_TARGET}\s+unused\b", "dead-code-check", "target"),
    (rf"\bwhat(?:'s|\s+is)\s+the\s+riskiest\s+file{_SCOPE}\b", "riskiest-file", "scope"),
    (rf"\bwhich\s+file\s+is\s+(?:the\s+)?riskiest{_SCOPE}\b", "riskiest-file", "scope"),
    (rf"\bwhat(?:'s|\s+is)\s+(?:not\s+tested|untested){_SCOPE}\b", "untested", "scope"),
    (rf"\buntested\s+(?:files|code|things|symbols){_SCOPE}\b", "untested", "scope"),
    (rf"\bwhat\s+lacks?\s+(?:test\s+)?coverage{_SCOPE}\b", "untested", "scope"),
)


def trimmed(question: Column) -> Column:
    return F.regexp_replace(F.trim(question), QUESTION_END, "")


def intent(question: Column) -> Column:
    """struct(intent, target, scope); null where no rule fits. A rule whose target is nothing but marks is passed over."""
    text, out = trimmed(question), F.lit(None).cast("struct<intent:string,target:string,scope:string>")
    for pattern, name, group in reversed(RULES):
        found = F.nullif(F.regexp_replace(F.regexp_extract(text, f"(?i){pattern}", 1), VALUE_END, ""), F.lit(""))
        none = F.lit(None).cast("string")
        made = F.struct(F.lit(name).alias("intent"), (found if group == "target" else none).alias("target"), (found if group == "scope" else none).alias("scope"))
        fits = text.rlike(f"(?i){pattern}")
        out = F.when(fits & found.isNotNull() if group == "target" else fits, made).otherwise(out)
    return out


def parse(question: str) -> dict | None:
    """As ``intent``, of one question; None is the refusal."""
    text = re.sub(QUESTION_END, "", question.strip())
    for pattern, name, group in RULES:
        if found := re.search(pattern, text, re.IGNORECASE):
            value = re.sub(VALUE_END, "", found[1] or "") or None
            if value or group == "scope":
                return {"intent": name, group: value}
    return None
