"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACES = " \t\n\x0b\f\r"
#: Fixed value: white space as Unicode has it.
WHITE = SPACES + "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: names that mark evaluation splits.
EVAL_SPLIT = r"(?i)(?:^|[_./\-])(test|valid|validation|dev)(?:[_./\-]|$)"


def n_tokens(text: Column) -> Column:
    """White-space tokens; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("bigint")


def has_token(text: Column) -> Column:
    """Whether there is a white-space token, settled at the first."""
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def non_empty(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def blank(text: Column) -> Column:
    """Null, empty, or white space alone, of any script."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)) == ""


def is_eval_split(name: Column) -> Column:
    return name.rlike(EVAL_SPLIT)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def rebased(path: Column, root: str) -> Column:
    """The same file name under another root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), base_name(path))


def bucket_and_prefix(url: Column) -> Column:
    """``gs://bucket/prefix`` as a struct."""
    return F.struct(F.regexp_extract(url, r"^gs://([^/]+)/?(.*)$", 1).alias("bucket"), F.regexp_extract(url, r"^gs://([^/]+)/?(.*)$", 2).alias("prefix"))


def name_hash(name: Column) -> Column:
    """The first four bytes of a name's SHA-256, big-endian."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")


def is_digest(value: Column) -> Column:
    """Sixty-four hexadecimal digits."""
    return value.rlike("^[0-9a-fA-F]{64}$")


def bytes_per_token(text: Column, tokens: Column) -> Column:
    """UTF-8 bytes for each token; an empty text has 0."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.octet_length(text) / F.greatest(tokens, F.lit(1)))


def task_form(alias: Column) -> Column:
    """``task:form`` (with or without ``::olmes`` behind) as a struct; forms are mc and rc."""
    plain = F.regexp_replace(alias, "::olmes$", "")
    has = plain.rlike(":(mc|rc)$")
    return F.struct(
        F.when(has, F.regexp_replace(plain, ":(mc|rc)$", "")).otherwise(plain).alias("task"),
        F.when(has, F.substring_index(plain, ":", -1)).alias("form"),
    )


def shard_file(source: Column, tag: Column, k: Column, suffix: str) -> Column:
    """``<source><tag>_<five digits>.<suffix>``."""
    return F.concat(source, tag, F.lit("_"), F.lpad(k.cast("string"), 5, "0"), F.lit("." + suffix))


def json_kind(text: Column) -> Column:
    """What a JSON text is: OBJECT, ARRAY, VARCHAR, BOOLEAN, NULL, or the number's type; null for none of these.

    Null too where an object, array or string is cut short or malformed; what follows its end is not looked at.
    """
    inner = F.btrim(text, F.lit(" \t\n\r"))
    first = F.substring(inner, 1, 1)
    number = F.when(inner.rlike("[.eE]"), "DOUBLE").when(first == "-", "BIGINT").otherwise("UBIGINT")
    broken = first.isin("{", "[", '"') & F.get_json_object(inner, "$").isNull()
    return F.when(broken, None).when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "VARCHAR").when(inner.isin("true", "false"), "BOOLEAN").when(inner == "null", "NULL").when(inner.rlike("^-?[0-9]"), number)
