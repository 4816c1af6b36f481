"""Coercions, ids, texts and digests: column expressions in the JVM, but for the digest of many texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spindrel.errors import CompositionError

#: Tokens that mean "missing", words of flags, the UUID name space of record ids (DNS, RFC 4122), prefixes.
MISSING = ("nan", "none", "null", "<na>")
TRUE, FALSE = ("true", "1", "yes", "y", "si", "sí"), ("false", "0", "no", "n", "")
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
PREFIXES = {"query": "query: ", "passage": "passage: "}
STRATEGIES = {"raw_text": "the text, or the title if there is none", "title_only": "the title", "title_brand_color": "title, brand and color"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_scalar(c: Column) -> Column:
    """Trimmed text; null and the tokens for missing values are empty."""
    text = strip(c.cast("string"))
    return F.when(text.isNull() | F.lower(text).isin(*MISSING), "").otherwise(text)


def clean_flag(c: Column) -> Column:
    """True or false; other words are an error."""
    text = F.lower(clean_scalar(c))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), text)).cast("boolean"))


def clean_version(c: Column) -> Column:
    """A whole number, cut off towards zero; null if it is no number."""
    return clean_scalar(c).try_cast("double").cast("int")


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5: SHA-1 of name space and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_uuid5(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def default_locale(c: Column, locale: str = "es") -> Column:
    return F.when(clean_scalar(c) == "", locale).otherwise(clean_scalar(c))


def compose(strategy: str, title: Column, brand: Column, color: Column, text: Column) -> Column:
    """The text that is encoded; require_composed refuses empty ones."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    if strategy == "raw_text":
        return strip(F.coalesce(F.nullif(text, F.lit("")), title))
    if strategy == "title_only":
        return strip(title)
    if strategy == "title_brand_color":
        return strip(F.concat_ws(". ", F.nullif(title, F.lit("")), part("Marca: ", brand), part("Color: ", color)))
    raise ValueError(f"no such strategy: {strategy}")


def require_composed(rows: DataFrame, composed: str) -> DataFrame:
    """rows, if no composed text is empty."""
    if not rows.where(F.coalesce(F.col(composed), F.lit("")) == "").isEmpty():
        raise CompositionError("a row has nothing to compose a text from")
    return rows


def title_prefix(title: Column, size: int = 80) -> Column:
    """The first characters of a title, for reports."""
    return F.substring(title, 1, size)


def is_e5(model: Column) -> Column:
    return model.rlike(r"(?i)(^|[/_-])e5([-_.]|$)")


def apply_prefix(text: Column, role: str, model: Column) -> Column:
    """The role's prefix in front of the trimmed text, once, and for E5 models only."""
    prefix, bare = PREFIXES[role], strip(text)
    return F.when(~is_e5(model) | F.lower(bare).startswith(prefix.strip()), bare).otherwise(F.concat(F.lit(prefix), bare))


def texts_digest(rows: DataFrame, position: str, text: str, groups: list[str] | None = None) -> DataFrame:
    """Groups, digest and n_texts: SHA-256 over each text and a NUL, in order of position.

    A digest reads its texts one after another, so a group's texts pass through one task, as a sorted stream.
    """
    names = groups or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n, done = None, hashlib.sha256(), 0, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, value in zip(*columns[: len(names)], columns[-1], strict=True):
                if n and key != now:
                    done.append((*now, sha.hexdigest(), n))
                    sha, n = hashlib.sha256(), 0
                now, n = key, n + 1
                sha.update((value or "").encode() + b"\0")
        if n:
            done.append((*now, sha.hexdigest(), n))
        kinds = [*schema[:-2], pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], kind) for c, kind in enumerate(kinds)], names=[*names, "digest", "n_texts"])

    slim = rows.select(*names, F.col(position).alias("_position"), F.col(text).alias("_text"))
    schema = [*to_arrow_schema(slim.select(*names).schema).types, None, None] if names else [None, None]
    dealt = (slim.repartition(*names) if names else slim.repartition(1)).sortWithinPartitions(*names, "_position")
    out = ", ".join([*(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in names), "digest string, n_texts long"])
    return dealt.mapInArrow(run, out)


def split_list(c: Column) -> Column:
    """Upper-case entries of a comma list without blanks."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.upper(strip(x))), lambda x: x != ""))


def positions(rows: DataFrame, order: str) -> DataFrame:
    """pos, from 0 in the given order, without one task holding all rows: offsets of range partitions plus local ranks."""
    ranged = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(base), "_part").withColumn("pos", (F.col("_base") + F.col("_local")).cast("long")).drop("_part", "_local", "_base")
