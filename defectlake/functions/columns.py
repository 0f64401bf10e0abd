"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def display_name(name) -> Column:
    """``magic_number`` as ``Magic Number``."""
    return F.initcap(F.replace(_c(name), F.lit("_"), F.lit(" ")))


def label_numbers(label) -> tuple[Column, Column]:
    """Lab and question of ``Lab 3 Q12``; 999 for both where the label has another form."""
    lab, question = (F.regexp_extract(_c(label), r"^Lab (\d+) Q(\d+)$", i).try_cast("int") for i in (1, 2))
    return F.coalesce(lab, F.lit(999)), F.coalesce(question, F.lit(999))


def file_name(label) -> Column:
    return F.concat(F.replace(_c(label), F.lit(" "), F.lit("_")), F.lit(".json"))


def task_of_group(group) -> Column:
    """The task id before the first underscore of a group id."""
    return F.split_part(_c(group), F.lit("_"), F.lit(1))


def family_of_group(group) -> Column:
    """The rest of a group id after its first underscore."""
    return F.regexp_extract(_c(group), r"^[^_]*_(.*)$", 1)


def without_family(group, families: list[str]) -> Column:
    """A group id without one of the known family suffixes."""
    return F.regexp_replace(_c(group), "_(" + "|".join(families) + ")$", "")


def log_name(moment) -> Column:
    """Name of the log of an experiment that began at ``moment``."""
    return F.concat(F.lit("experiment-log-"), F.date_format(_c(moment), "ddMMyyHHmmss"), F.lit(".jsonl"))


def ratio(part, whole) -> Column:
    """part / whole, null where the whole is 0."""
    return F.try_divide(_c(part).cast("double"), _c(whole).cast("double"))


def name_union(first, second) -> Column:
    """The names of both lists, each once, in order of first appearance."""
    return F.array_distinct(F.concat(_c(first), _c(second)))


def wilson(successes, trials, z: float = Z) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval; (0, 1) without trials."""
    k, n = _c(successes).cast("double"), _c(trials).cast("double")
    p = k / F.greatest(n, F.lit(1.0))
    n1 = F.greatest(n, F.lit(1.0))
    below = 1 + z * z / n1
    middle = (p + z * z / (2 * n1)) / below
    half = z * F.sqrt(p * (1 - p) / n1 + z * z / (4 * n1 * n1)) / below
    none = n <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), middle + half))


def stable_seed(*parts) -> Column:
    """First 8 bytes of the SHA-256 of the parts joined by |, as a number modulo 2147483647."""
    joined = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return (F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)") % 2147483647).cast("long")


#: The characters that ``str.strip`` takes, as a class of a pattern.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def stripped(text) -> Column:
    """A text without blanks at its ends."""
    return F.regexp_replace(_c(text), rf"\A{BLANK}+|{BLANK}+\z", "")


def normal_output(text) -> Column:
    """Line ends as LF, no blanks at line ends or around the whole."""
    lines = F.split(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, rf"{BLANK}+\z", ""))
    return stripped(F.array_join(trimmed, "\n"))


def true_names(flags) -> Column:
    """Names of a map whose flag is true, in order."""
    return F.array_sort(F.map_keys(F.map_filter(_c(flags), lambda k, v: F.coalesce(v, F.lit(False)))))
