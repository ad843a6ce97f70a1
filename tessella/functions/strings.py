"""String and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chomp(s: Column) -> Column:
    """Without trailing white space."""
    return F.regexp_replace(s, r"\s+$", "")


def pre_chomp(s: Column) -> Column:
    """Without leading white space."""
    return F.regexp_replace(s, r"^\s+", "")


def split_tokens(s: Column, delimiters: str) -> Column:
    """Tokens between any of the characters in ``delimiters``; empty ones vanish."""
    escaped = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in delimiters)
    return F.filter(F.split(s, f"[{escaped}]+"), lambda t: t != "")


def replace_first(s: Column, match: str, replacement: str) -> Column:
    at = F.instr(s, match)
    rest = F.substring(s, at + len(match), F.length(s))
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(replacement), rest)).otherwise(s)


def replace_all(s: Column, match: str, replacement: str) -> Column:
    return F.replace(s, F.lit(match), F.lit(replacement))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """What stands before the last slash, or '.' without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, or ''."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def relative_path(path: Column, base: Column) -> Column:
    """``path`` seen from the folder ``base``: common folders are left out, one '..' stands for each other one of ``base``."""
    a, b = F.split(path, "/"), F.split(base, "/")
    least = F.least(F.size(a), F.size(b))
    same = F.aggregate(
        F.sequence(F.lit(1), least),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.element_at(a, i.cast("int")) == F.element_at(b, i.cast("int"))), i.cast("int")).otherwise(n),
    )
    ups = F.array_repeat(F.lit(".."), F.size(b) - same)
    return F.array_join(F.concat(ups, F.slice(a, same + 1, F.greatest(F.size(a) - same, F.lit(0)))), "/")


def is_safe_name(s: Column) -> Column:
    """No slash, backslash or tilde."""
    return ~s.rlike(r"[/\\~]")


def common_prefix(names: Column) -> Column:
    """The longest common prefix of an array of strings."""
    first = F.element_at(names, 1)
    lengths = F.sequence(F.lit(0), F.length(first))
    good = F.filter(lengths, lambda n: F.forall(names, lambda x: F.left(x, n) == F.left(first, n)))
    return F.left(first, F.array_max(good))


def answer_of(code: Column) -> Column:
    """'answer,certainty,seconds' as a struct."""
    part = F.split(code, ",")
    return F.struct(
        F.element_at(part, 1).cast("int").alias("answer"), F.element_at(part, 2).cast("int").alias("certainty"), F.element_at(part, 3).cast("float").alias("seconds")
    )


def answer_code(answer: Column, certainty: Column, seconds: Column) -> Column:
    return F.concat_ws(",", answer.cast("string"), certainty.cast("string"), F.format_string("%f", seconds.cast("double")))


def full_path(path: Column, base: Column) -> Column:
    """``path`` itself if it begins at a root or a drive, else within ``base``."""
    return F.when(path.rlike(r"^(/|.:[/\\])"), path).otherwise(F.concat_ws("/", base, path))


def safe_name(s: Column) -> Column:
    """Every character but ASCII letters, digits, '_', '.' and '-' as '_'."""
    return F.regexp_replace(s, r"[^A-Za-z0-9_.-]", "_")


def user_and_image(s: Column) -> Column:
    """'user_image..' as (user, image): what stands before the first underscore, and between that and the next."""
    part = F.split(s, "_")
    return F.struct(F.get(part, F.lit(0)).alias("user"), F.get(part, F.lit(1)).alias("image"))


def valid_species(s: Column) -> Column:
    """Letters, apostrophes, hyphens and spaces only, and at least one."""
    return s.rlike(r"^[a-zA-Z'\- ]+$")


def valid_count(s: Column) -> Column:
    """Digits only, and at least one."""
    return s.rlike(r"^[0-9]+$")


def upper_case(s: Column) -> Column:
    """a-z as A-Z; other characters stay."""
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def lower_case(s: Column) -> Column:
    """A-Z as a-z; other characters stay."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
