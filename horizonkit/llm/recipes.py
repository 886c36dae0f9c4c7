"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut where its own characters say so, so equal texts have equal
chunks. A chunk is named by its 64-bit hash and the names are verified: chunks
are grouped by their text, and where one hash names several texts their rank
tells them apart. A document is then the ordered list of its chunks' names, and
equal lists are equal texts. Chunk texts move once, copies within a task only
as one; the lists, a few bytes for each hundred characters, do the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonkit.llm.common import unused
from horizonkit.session import written

#: Characters of a chunk at least and at most; in between it ends where the rule says so.
LEAST, MOST = 256, 4096
#: The rule: the last characters' codes have these remainders modulo 4 (one place in 64 of even text).
REMAINDERS = (1, 2, 0)


def _class(remainder: int) -> str:
    """Regular-expression class of the Latin-1 characters with a remainder modulo 4."""
    return "[" + "".join(f"\\u{c:04X}" for c in range(0x20, 0x100) if c % 4 == remainder) + "]"


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """Matches chunk after chunk of a text, and all of it."""
    n = len(REMAINDERS)
    return f"(?s).{{{least - n},{most - n}}}?{''.join(map(_class, REMAINDERS))}|.{{1,{most}}}"


def lower_ascii(text: Column) -> Column:
    """A-Z in small letters, all else as it is."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """A text's chunks in order, lower-cased; none for an empty text."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(chunk_pattern(least, most)), F.lit(0))


def _verified(cut: DataFrame, lists: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """``lists`` with ``ranks``: each chunk's rank among the texts of its name; empty where every name has one text."""
    # the outer form: a plain explode would first ask for the size of the chunks, and so make them twice
    texts = (cut.select(F.explode_outer("chunks").alias("chunk")).where(F.col("chunk").isNotNull())
             .select(name(F.col("chunk")).alias("name"), "chunk").distinct())
    shared = written(texts.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "shared_names")
    plain = lists.withColumn("ranks", F.array().cast("array<int>"))
    if shared.isEmpty():
        return plain
    place = Window.partitionBy("name").orderBy("chunk")
    ranked = texts.join(shared, "name").withColumn("rank", F.row_number().over(place))
    # only chunks of such names meet their texts again
    met = (cut.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("name", name(F.col("chunk")))
           .join(ranked, ["name", "chunk"]).groupBy("row")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rank"))), lambda x: x["rank"]).alias("ranks")))
    return lists.join(met, "row", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST,
                name: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Groups of texts equal but for the case of A-Z: a row for each row of ``docs``.

    Columns: ``id, recipe`` (names of its chunks, in order), ``ranks``, ``sha256`` (of the
    lower-cased text), ``keep_id`` (largest id of the group), ``group_size, kept``.

    Of the rows with a group's largest id one is kept. A null text counts as
    empty, and empty texts are equal to each other; a null id is smaller than
    any other, so ``keep_id`` is null only where all ids of a group are.
    Repeated rows stay as rows of their group. Texts of any length are cut and
    compared whole. Other columns play no part, whatever their names; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # equal texts may be a third of all rows: their rows and counts spread over this many parts
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = texts.select(F.monotonically_increasing_id().alias("row"), "id", chunks(F.col("text"), least, most).alias("chunks"))
    cut = written(cut.select("row", "id", "chunks", F.transform("chunks", lambda c: name(c)).alias("recipe"),
                             F.sha2(F.array_join("chunks", ""), 256).alias("sha256"),
                             F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")), "chunks")
    lists = _verified(cut, cut.drop("chunks"), name)
    same = ["recipe", "ranks"]
    some = lists.groupBy(*same, "part").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("last"))
    whole = some.groupBy(*same).agg(F.sum("n").alias("group_size"), F.max("last").alias("last"))
    of = some.select(*same, "part").join(whole, same)
    return lists.join(of, [*same, "part"]).select(
        "id", "recipe", "ranks", "sha256", F.col("last.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"))


def one_of_each_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated texts: of each group the row of largest id, columns and their order as they are.

    Of several rows with that id one stays. Nulls, empty texts and other
    columns as in ``equal_texts``.
    """
    key = [unused(docs, "__i"), unused(docs, "__t")]
    stay = (equal_texts(docs, id_col, text_col).where("kept")
            .select(F.xxhash64(F.col("id").isNull(), "id").alias(key[0]), F.col("sha256").alias(key[1])))
    number, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.withColumns({key[0]: F.xxhash64(number.isNull(), number), key[1]: F.sha2(lower_ascii(text), 256)})
    return plain.join(stay, key).dropDuplicates(key).select(*docs.columns)
