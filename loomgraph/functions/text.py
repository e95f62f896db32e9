"""Text column functions: ids, titles, step parsing, regex widening, code fences."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes and id length.
STEP_PREFIX = "gherkin_step_"
DEFINITION_PREFIX = "ruby_def_"
ID_HEX = 12
# The keywords a step line may start with; other lines are dropped.
STEP_KEYWORDS = ("Given", "When", "Then")
# Fixed value: file-name keyword -> story id, first rule wins.
FEATURE_RULES = (("withdraw", "banking_01_withdrawal.txt"), ("atm", "banking_04_daily_limit.txt"))
# Words that mark a change as unsafe.
UNSAFE_WORDS = ("malicious", "unacceptable")
# Fixed value: the number group of a definition and its widened form.
NUMBER_GROUP, WIDE_NUMBER_GROUP = r"is (\d+)", r"is (?:\$)?(\d+)"

# Java flags that give Python's meaning of \s, \d, \w (Unicode) and of '.' (all but \n)
PY = "(?Ud)"


def content_id(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.encode(text, "UTF-8")), 1, ID_HEX))


def strip(text: Column) -> Column:
    """Trim all Unicode white space (``trim`` only removes blanks)."""
    return F.regexp_replace(text, PY + r"^\s+|\s+\z", "")


def title_of(file_name: Column) -> Column:
    """File name to title; every run of letters is capitalised, also after digits and quotes."""
    plain = F.replace(F.replace(file_name, F.lit(".txt"), F.lit("")), F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(plain, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def route_feature(file_name: Column, rules=FEATURE_RULES) -> Column:
    """Story id of the first rule whose keyword is in the lower-cased file name, else NULL."""
    routed = F.lit(None).cast("string")
    for word, story in reversed(rules):
        routed = F.when(F.contains(F.lower(file_name), F.lit(word)), F.lit(story)).otherwise(routed)
    return routed


def step_pattern(keywords=STEP_KEYWORDS) -> str:
    return PY + r"\A(" + "|".join(keywords) + r")\s+(.*)$"


def normalise_step(text: Column) -> Column:
    """Strip the text, then drop one leading ``$`` standing before digits."""
    return F.regexp_replace(strip(text), PY + r"\A\$?(\d+)", "$1")


def unsafe_flag(text: Column, words=UNSAFE_WORDS) -> Column:
    flag = F.lit(False)
    for word in words:
        flag = flag | F.contains(F.lower(text), F.lit(word.lower()))
    return flag


def widen(expression: Column) -> Column:
    return F.replace(expression, F.lit(NUMBER_GROUP), F.lit(WIDE_NUMBER_GROUP))


def widen_code(code_block: Column, expression: Column) -> Column:
    """Carry the widened expression into the code block."""
    return F.replace(code_block, expression, widen(expression))


def strip_fence(text: Column) -> Column:
    opened = F.regexp_replace(strip(text), r"\A```ruby\n", "")
    # like Python's $, the closing fence may be followed by one newline
    return F.regexp_replace(opened, r"\n```(?=\n?\z)", "")


def api_call_id(uri: Column) -> Column:
    """First ``_`` token of the stem of ``…/name.jsonl``; NULL when the URI has no such file."""
    stem = F.nullif(F.regexp_extract(uri, r"/([^/]+)\.jsonl", 1), F.lit(""))
    return F.element_at(F.split(stem, "_"), 1)


def relation(depth: Column) -> Column:
    return F.when(depth == 1, F.lit("Direct Dependent")).otherwise(
        F.concat(F.lit("Indirect Dependent (Depth "), depth.cast("string"), F.lit(")")))


def ratio_or_one(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(part / total)


def percent_text(ratio: Column) -> Column:
    return F.format_string("%.2f%%", ratio * 100)


def clamp_score(score: Column) -> Column:
    """A missing verdict scores 0; any other is held within 1..5."""
    return F.when(score.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), score)))


def contains_text(reason: Column, wanted: Column) -> Column:
    return F.coalesce(F.contains(reason, wanted), F.lit(False))


def checklist(items: Column) -> Column:
    """One open check-box line per item of an array."""
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit("- [ ] "), item)), "\n")
