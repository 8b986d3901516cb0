"""Canonical JSON (fields in alphabetical order, compact, raw Unicode, nulls left out) and the digests built on it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as batch_type
from pyspark.sql.types import LongType, StringType, StructField, StructType


def canonical(value: Column) -> Column:
    """JSON of a struct whose fields stand in alphabetical order. Doubles are written Java's way; keep them out of digests."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def case_json(case: Column) -> Column:
    """A case with the defaults it may leave out filled in, at all three levels."""
    version = lambda s: s.withField("schema_version", F.coalesce(s["schema_version"], F.lit("1.0")))
    listed = lambda s, *names: s.withField(names[0], F.coalesce(s[names[0]], F.array())) if len(names) == 1 else listed(listed(s, names[0]), *names[1:])
    gold = version(case["gold"])
    return canonical(F.struct(gold.alias("gold"), version(case["input"]).alias("input"), case["license"].alias("license"), case["provenance"].alias("provenance"), case["review_status"].alias("review_status"), F.coalesce(case["schema_version"], F.lit("1.0")).alias("schema_version"), case["source"].alias("source"), case["split"].alias("split")))


def case_digest(text: Column) -> Column:
    """Of a case's canonical JSON, with the line feed that ends it."""
    return digest(F.concat(text, F.lit("\n")))


def payload_digest(text: Column) -> Column:
    """Of a tool payload: no line feed."""
    return digest(text)


def dataset_digest(rows: DataFrame, pos: str, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One digest for all rows in the order of pos: what the whole file would hash to. A digest of a sequence must see its rows one after
    another, so those of a dataset go through one task; they stream through it, sorted, and only the digest is held. by: one for each part."""
    keys, schema = len(by), StructType([*[rows.schema[c] for c in by], StructField("dataset_sha256", StringType()), StructField("n_rows", LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, n, joint, done = None, None, 0, b"", []

        def close():
            sha.update(b"]\n")
            done.append((*key, sha.hexdigest(), n))

        for batch in batches:
            for *own, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if sha is None or own != key:
                    if sha is not None:
                        close()
                    key, sha, n, joint = own, hashlib.sha256(b"["), 0, b""
                n += 1
                if t is not None:
                    sha.update(joint + t.encode())
                    joint = b","
        if sha is not None:
            close()
        columns = list(zip(*done, strict=True)) or [()] * (keys + 2)
        kinds = [batch_type(f.dataType) for f in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

    dealt = rows.repartition(*by) if by else rows.repartition(1)
    return dealt.sortWithinPartitions(*by, pos, text).select(*by, text).mapInArrow(fold, schema)


#: Lower-case characters that case folding makes another of, or several (sharp s, final sigma, ligatures, ..); they follow from Unicode.
FOLDS = {c: c.casefold() for c in map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x2FA20))) if c.lower() == c != c.casefold()}


def _ranges(chars: list[str], gap: int = 0x200) -> str:
    """A class for Java patterns that holds these characters, and few others: runs of them with gaps as wide as this in one range."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c < 0x250 and c - out[-1][1] > 1 or not out or c - out[-1][1] > gap:
            out.append([c, c])
        out[-1][1] = c
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


_MAY_FOLD = _ranges(list(FOLDS))


def folded(text: Column) -> Column:
    """Case folding by built-ins: lower case, then the characters above. One pass looks for what may be one of them; of those that a text
    has, each is replaced, and most texts have none."""
    lower, table = F.lower(text), F.create_map(*[F.lit(x) for pair in FOLDS.items() for x in pair])
    found = F.filter(F.array_distinct(F.regexp_extract_all(lower, F.lit(_MAY_FOLD), F.lit(0))), lambda c: table[c].isNotNull())
    return F.when(lower.rlike(_MAY_FOLD), F.aggregate(found, lower, lambda t, c: F.replace(t, c, table[c]))).otherwise(lower)


def run_id(prefix: str, hash_: Column, length: int) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(hash_, 1, length))


def attempt_id(run: Column, case: Column) -> Column:
    return F.concat_ws(":", run, case, F.lit("1"))


def safe_name(name: Column) -> Column:
    """Whether a case id can be a file name."""
    return name.rlike(r"^[A-Za-z0-9_.-]+$") & ~name.isin(".", "..")


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.when((tokens == 0) | (seconds == 0), F.lit(0.0)).otherwise(tokens / seconds)
