"""How often every distinct value occurs in a collection, and in how many records.

The values get integer identifiers from a global dictionary: a block, which is a range of identifiers chosen by hash,
and a slot within it. Occurrences and record presence are accumulated in one count array for each block and source
slice, and the arrays of a block are then summed. No step gathers the rows of one value: what a value contributes is
reduced to one row in each partition before it is sent on, so a value that holds a third of all rows costs no more
than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A term made of white space alone, of any kind, is blank.
BLANK = r"^[\s\p{Z}\x{FEFF}]*$"


def _is_term(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(BLANK)


def _one_row_each(df: DataFrame, key: str | None, cols: list[str]) -> DataFrame:
    """One row for each key; a null key is a row of its own. Among rows that differ, the greatest values stay."""
    if key is None:
        return df.select(*cols)
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*cols)).alias("r")).select("r.*")
    return keyed.unionByName(df.where(F.col(key).isNull()).select(*cols))


def term_dictionary(terms: DataFrame, term: str = "term", blocks: int = 64) -> DataFrame:
    """The distinct terms with identifiers: (term, block INT, slot INT, id BIGINT).

    Identifiers are the same in every run over the same terms, however they are partitioned.
    """
    seen = terms.select(F.col(term).alias("term")).where(F.col("term").isNotNull()).distinct()
    seen = seen.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    order = Window.partitionBy("block").orderBy("term")
    return seen.withColumn("slot", F.row_number().over(order) - 1).withColumn(
        "id", F.shiftleft(F.col("block").cast("long"), 40) + F.col("slot")
    )


def _accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the encoded rows of one partition, in order of block and slice, a count array for each block and slice.

    An array is given out as soon as its rows end, so that one block's is held at a time.
    """
    at: tuple[int, int] | None = None
    occ = has = np.zeros(0, dtype=np.int64)

    def made() -> pd.DataFrame:
        return pd.DataFrame({"block": [at[0]], "part": [at[1]], "occ": [occ], "has": [has]})

    for batch in batches:
        for (block, part), rows in batch.groupby(["block", "part"]):
            if (block, part) != at:
                if at is not None:
                    yield made()
                at, occ, has = (int(block), int(part)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            n = int(rows["slot"].max()) + 1
            if n > len(occ):
                occ, has = (np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=np.int64)]) for a in (occ, has))
            np.add.at(occ, rows["slot"].to_numpy(), rows["occurrences"].to_numpy())
            np.add.at(has, rows["slot"].to_numpy(), rows["records"].to_numpy())
    if at is not None:
        yield made()


def _sum_blocks(block: pd.DataFrame) -> pd.DataFrame:
    """The sum of a block's arrays, one row for each slot."""
    n = max(map(len, block["occ"]))
    occ, has = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for o, h in zip(block["occ"], block["has"]):
        occ[: len(o)] += o
        has[: len(h)] += h
    return pd.DataFrame(
        {"block": int(block["block"].iloc[0]), "slot": np.arange(n, dtype=np.int32), "occurrences": occ, "records": has}
    )


def term_frequencies(
    df: DataFrame,
    term: str = "normalizedKeyword",
    record: str = "id",
    occurrences: str | None = "occurrences",
    row_key: str | None = "result_id",
    terms_per_block: int = 20_000,
    slices: int = 8,
) -> DataFrame:
    """Every distinct term with its total of occurrences and the number of distinct records it occurs in.

    Result: (term STRING, occurrences BIGINT, records BIGINT), one row for each term exactly as stored.

    Rows with the same row_key count once. A null or blank term is no term; a null count adds 0; without a counting
    column each row adds 1; a null record adds its occurrences but no record. An empty table gives no rows. Other
    columns are ignored, whatever their names. A task holds the arrays of one block at a time, of about terms_per_block
    numbers for each slice, as blocks grow in number, not in size, with the terms.
    """
    count = F.coalesce(F.col(occurrences).cast("long"), F.lit(0)) if occurrences else F.lit(1).cast("long")
    key = [F.col(row_key).alias("k")] if row_key else []
    rows = df.select(*key, F.col(term).alias("term"), F.col(record).cast("string").alias("record"), count.alias("n"))
    rows = _one_row_each(rows.where(_is_term(F.col("term"))), "k" if row_key else None, ["term", "record", "n"])
    # one row for each term and record: spread over both keys, so no term is gathered here
    pairs = rows.groupBy("term", "record").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64("record"), F.lit(slices)).cast("int")
    # combined on the sending side, a term leaves one row for each partition and slice
    partial = pairs.groupBy("term", part.alias("part")).agg(
        F.sum("n").alias("occurrences"), F.count("record").alias("records")
    )
    distinct = df.where(_is_term(F.col(term))).agg(F.approx_count_distinct(term)).first()[0]
    blocks = max(8, -(-int(distinct) // terms_per_block))
    dictionary = term_dictionary(partial, "term", blocks)
    encoded = partial.join(dictionary.select("term", "block", "slot"), "term").select(
        "block", "slot", "part", "occurrences", "records"
    )
    arrays = encoded.repartition(F.col("block"), F.col("part")).sortWithinPartitions("block", "part").mapInPandas(
        _accumulate, "block int, part int, occ array<bigint>, has array<bigint>"
    )
    sums = arrays.groupBy("block").applyInPandas(
        _sum_blocks, "block int, slot int, occurrences bigint, records bigint"
    )
    return dictionary.join(sums, ["block", "slot"]).select("term", "occurrences", "records")


def mark_terms(frequencies: DataFrame, total: int, rare_below: int = 3, common_above: float = 0.02) -> DataFrame:
    """Marks for terms too rare or too common to be useful: (term, mark); a term with both marks gives two rows.

    total is the number of distinct records. A term is common in more than the share common_above of them.
    """
    marks = F.array_compact(
        F.array(
            F.when(F.col("occurrences") < rare_below, F.lit("rare")),
            F.when(F.col("records") > F.lit(total * common_above), F.lit("common")),
        )
    )
    return frequencies.select("term", F.explode(marks).alias("mark"))


def count_records(df: DataFrame, record: str = "id") -> int:
    """The number of distinct records; a null is none."""
    return df.select(record).distinct().agg(F.count(record)).first()[0]
