"""SentencePiece encoding and decoding as relations: a lattice of pieces by word, folded with a higher-order aggregate.

Texts are dealt out once, by rows, into groups of a bounded size. Within a group, which no later step leaves, texts are cut into
words; the distinct words are exploded into their substrings of up to the longest piece's length, and an equi-join with the piece
table keeps those that are pieces: the edges of the words' lattices, grouped by word together with the places where the word
stands. A fold over a word's edges gives its pieces, which go back to the documents by these places. The piece table has the
vocabulary's size, so it alone is broadcast. A common word costs a group one lattice, and its places are those of one group only,
so no key gathers the corpus. Nothing is written beside the one shuffle of the texts.

Two folds. viterbi takes the path with the largest sum of scores, as unigram models do (of equals the longest last piece). The
public model is a byte-pair one: its library merges the best neighbouring pair first, and its ids are those of another path. So
merges folds the same lattice as that library does: each step joins the two neighbours whose joint edge has the best score, the
leftmost of equals. Characters without a piece become their UTF-8 bytes' pieces. Words of any length go this way; the folds' work
grows with a word's length times its edges.

A word is a run of space signs with the letters, or with the other characters, behind it: no piece reaches over such a cut, which
pieces() makes sure of.

Null and empty texts have no pieces and decode to an empty text. Rows are encoded each, repeated ones too; equal ids or texts have
no meaning. A null doc_id stays null. An empty table gives no rows. Other columns aren't read. U+2581 in a text decodes to a space,
as in the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.llm.shared import partitions_for, table, vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: What a character without a piece costs a path.
UNKNOWN = -1e6
#: Bytes of files whose texts make a group.
GROUP_BYTES = 16 << 20
FOLDS = ("viterbi", "merges")


def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model))


def pieces(spark: SparkSession, model: str = MODEL) -> tuple[DataFrame, int, int]:
    """piece, id, score of a model's text pieces, the longest one's length, and the id of byte 0's piece."""
    own = _processor(model)
    rows = [(own.id_to_piece(i), i, own.get_score(i)) for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))]
    for p, _, _ in rows:
        cuts = re.sub(f"^{SPACE}+", "", p)
        if SPACE in cuts or len({c.isalpha() for c in cuts}) > 1:
            raise ValueError(f"the piece {p!r} reaches over a cut between words")
    return spark.createDataFrame(rows, "piece string, id int, score double"), max(len(p) for p, _, _ in rows), own.piece_to_id("<0x00>")


def words(text: Column) -> Column:
    """Space signs with the letters or the other characters behind them; the text gets one sign in front."""
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(rf"(?s){SPACE}*\p{{L}}+|{SPACE}*[^{SPACE}\p{{L}}]+|{SPACE}+"), F.lit(0)))


def named_struct(**fields: Column) -> Column:
    """A struct whose names hold within lambdas too."""
    return F.named_struct(*(x for name, c in fields.items() for x in (F.lit(name), c)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lattices(distinct: DataFrame, table_: DataFrame, longest: int, keys: tuple[str, ...] = ("word",), carried: str | None = None) -> DataFrame:
    """keys, carried and edges, an array of (end, start, id, score) in order, of distinct words; keys hold word.

    A character without a piece has an edge without an id. The carried column rides on a row of its own, start -1.
    """
    n = F.coalesce(F.length("word"), F.lit(0))
    held = [F.when(F.col("start") < 0, F.col(carried)).alias(carried)] if carried else []
    starts = distinct.select(*keys, *([carried] if carried else []), F.explode(F.sequence(F.lit(-1), n - 1)).alias("start")).select(*keys, *held, "start")
    reach = F.when(F.col("start") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + longest)))
    ends = starts.select("*", F.explode(reach).alias("end")).withColumn("piece", F.expr("if(start < 0, null, substring(word, start + 1, end - start))"))
    found = ends.join(F.broadcast(table_), "piece", "left").filter("id is not null or end = start + 1 or start < 0")
    edge = F.when(F.col("start") >= 0, F.struct("end", "start", "id", F.coalesce("score", F.lit(UNKNOWN)).alias("score")))
    return found.groupBy(*keys).agg(*([F.first(carried, ignorenulls=True).alias(carried)] if carried else []), F.array_sort(F.collect_list(edge)).alias("edges"))


def bytes_of(c: Column, first_byte: int) -> Column:
    """The ids of a character's UTF-8 bytes."""
    hexed = F.hex(F.encode(c, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))
    return F.transform(at, lambda i: F.conv(F.substring(hexed, i, 2), 16, 10).cast("int") + first_byte)


def named(word: Column, a: Column, b: Column, id_: Column, first_byte: int) -> Column:
    """The ids of a word's piece from a to b."""
    return F.when(id_.isNotNull(), F.array(id_)).otherwise(bytes_of(F.substring(word, a + 1, b - a), first_byte))


def viterbi(first_byte: int) -> Column:
    """The ids of the path with the largest sum of scores over word and edges: forward over the edges by their ends, then back."""
    best = "array<struct<score:double,back:int,id:int>>"
    start = F.array(named_struct(score=F.lit(0.0), back=F.lit(0), id=F.lit(None).cast("int"))).cast(best)

    def relax(held: Column, e: Column) -> Column:
        score = F.get(held, e["start"])["score"] + e["score"]
        own = F.array(named_struct(score=score, back=e["start"], id=e["id"]))
        # edges come by end, then by start: a later one with the same sum has a shorter last piece
        replaced = F.when(score > F.get(held, e["end"])["score"], F.concat(F.slice(held, F.lit(1), e["end"]), own)).otherwise(held)
        return F.when(F.size(held) == e["end"], F.concat(held, own)).otherwise(replaced).cast(best)

    way = "struct<at:int,ids:array<int>>"

    def step(table_: Column, path: Column) -> Column:
        last = F.get(table_, path["at"])
        own = named(F.col("word"), last["back"], path["at"], last["id"], first_byte)
        return F.when(path["at"] == 0, path).otherwise(named_struct(at=last["back"], ids=F.concat(own, path["ids"]))).cast(way)

    end = named_struct(at=F.length("word"), ids=F.array().cast("array<int>")).cast(way)
    back = lambda table_: F.aggregate(F.sequence(F.lit(1), F.length("word")), end, lambda path, _: step(table_, path))["ids"]
    return let(F.aggregate("edges", start, relax), back)


def merges(first_byte: int) -> Column:
    """The ids after all merges, over word and edges: the inner bounds between pieces, each with the score of the edge over it."""
    bounds = "array<struct<score:double,left:int>>"
    key = lambda a, b: a.cast("long") * (1 << 31) + b
    n = F.length("word")

    def folded(by_span: Column) -> Column:
        score = lambda a, b: F.try_element_at(by_span, key(a, b))["score"]
        bound = lambda a, i, b: named_struct(score=score(a, b), left=-i)
        singles = F.when(n < 2, F.array().cast(bounds)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: bound(i - 1, i, i + 1)).cast(bounds))
        # the place of the k-th bound (from 0); before the first is the word's start, behind the last its end
        place = lambda held, k: F.when(k < 0, F.lit(0)).when(k >= F.size(held), n).otherwise(-F.get(held, k)["left"])

        def joined(held: Column, k: Column) -> Column:
            a, b = place(held, k - 1), place(held, k + 1)
            before = F.when(k > 0, F.array(bound(place(held, k - 2), a, b)).cast(bounds)).otherwise(F.array().cast(bounds))
            behind = F.when(k < F.size(held) - 1, F.array(bound(a, b, place(held, k + 2))).cast(bounds)).otherwise(F.array().cast(bounds))
            head = F.when(k > 1, F.slice(held, F.lit(1), F.greatest(F.lit(0), k - 1))).otherwise(F.array().cast(bounds))
            return F.concat(head, before, behind, F.slice(held, k + 3, F.size(held))).cast(bounds)

        def step(held: Column, _: Column) -> Column:
            # the best score, and of equals the leftmost bound
            return let(F.array_max(held), lambda best: F.when(best["score"].isNull(), held).otherwise(let(F.array_position(held, best).cast("int") - 1, lambda k: joined(held, k))))

        inner = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), singles, lambda held, i: F.when(F.size(held) == 0, held).otherwise(step(held, i)).cast(bounds))
        ends = lambda held: F.concat(F.array(F.lit(0)), F.transform(held, lambda x: -x["left"]), F.array(n))

        def ids(at: Column) -> Column:
            spans = F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: named_struct(a=F.get(at, k), b=F.get(at, k + 1)))
            return F.flatten(F.transform(spans, lambda s: named(F.col("word"), s["a"], s["b"], F.try_element_at(by_span, key(s["a"], s["b"]))["id"], first_byte)))

        return let(ends(inner), ids)

    known = F.filter("edges", lambda e: e["id"].isNotNull())
    return let(F.map_from_entries(F.transform(known, lambda e: F.struct(key(e["start"], e["end"]), named_struct(score=e["score"], id=e["id"])))), folded)


def encode(docs: DataFrame, model: str = MODEL, folds: tuple[str, ...] = ("merges",)) -> DataFrame:
    """doc_id, n_words and for each fold its ids (ids of the first, ids_<fold> of others) of docs (doc_id, text); and grp, row: by grp the rows are dealt out, by row they differ."""
    table_, longest, first_byte = pieces(docs.sparkSession, model)
    parts = partitions_for(docs, GROUP_BYTES)
    # dealt out by row, so that no id or text that many rows share makes a group large
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).repartition(parts, "grp")
    placed = rows.select("grp", "row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("place", "word"))
    distinct = placed.groupBy("grp", "word").agg(F.collect_list(F.struct("row", "doc_id", "place")).alias("places"))
    edges = lattices(distinct, table_, longest, ("grp", "word"), "places")
    made = {"viterbi": viterbi, "merges": merges}
    none = F.array().cast("array<int>")
    columns = ["ids", *(f"ids_{f}" for f in folds[1:])]
    own = [F.when(F.col("word").isNull(), none).otherwise(made[f](first_byte)).alias(c) for f, c in zip(folds, columns)]
    # folded once a word: an explode beside the folds in one select would come first, and fold each place anew
    folded = edges.select("grp", *own, "places")
    found = folded.select("grp", *columns, F.explode("places").alias("at")).select("grp", "at.row", "at.doc_id", "at.place", *columns)
    sorted_ = found.groupBy("grp", "row").agg(F.first("doc_id").alias("doc_id"), F.count("place").alias("n_words"), F.array_sort(F.collect_list(F.struct("place", *columns))).alias("found"))
    return sorted_.select("grp", "row", "doc_id", "n_words", *(F.flatten(F.col(f"found.{c}")).alias(c) for c in columns))


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """encoded (grp, row, ids, ...) with text: pieces by an equi-join on the id, in order, as bytes; the front sign goes."""
    spark = encoded.sparkSession
    table_, _, first_byte = pieces(spark, model)
    shown = table_.select("id", F.hex(F.encode("piece", "UTF-8")).alias("bytes")).unionByName(spark.range(256).select((F.col("id") + first_byte).cast("int").alias("id"), F.lpad(F.hex("id"), 2, "0").alias("bytes")))
    others = [c for c in encoded.columns if c not in ("grp", "row")]
    rows = encoded.select("*", F.posexplode_outer(ids).alias("_place", "_id"))
    # what isn't to be sorted once an id rides on the first one's row
    riding = F.when(F.coalesce(F.col("_place"), F.lit(0)) == 0, F.struct(*others)).alias("_own")
    joined = rows.select("grp", "row", riding, "_place", "_id").join(F.broadcast(shown.select(F.col("id").alias("_id"), "bytes")), "_id", "left")
    texts = joined.groupBy("grp", "row").agg(F.first("_own", ignorenulls=True).alias("_own"), F.array_sort(F.collect_list(F.struct("_place", "bytes"))).alias("_bytes"))
    joint = F.array_join(F.transform("_bytes", lambda x: x["bytes"]), "")
    plain = F.replace(F.decode(F.unhex(joint), "UTF-8"), F.lit(SPACE), F.lit(" "))
    return texts.select("grp", "row", "_own.*", F.coalesce(F.substr(plain, F.lit(2)), F.lit("")).alias("text"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's Viterbi ids, of the text that they decode to, and of the library's (merged) ids."""
    rows = encode(table(spark, sf_dir, "documents"), folds=FOLDS)
    digest = lambda c: F.crc32(F.array_join(c, " ").cast("binary"))
    sums = [F.size("ids").cast("long").alias("n_pieces"), digest("ids").alias("ids_crc32"), F.size("ids_merges").cast("long").alias("n_merged"), digest("ids_merges").alias("merged_crc32")]
    told = decode(rows.select("grp", "row", "doc_id", "n_words", "ids", *sums))
    return told.select("doc_id", "n_words", "n_pieces", "ids_crc32", "n_merged", "merged_crc32", F.length("text").cast("long").alias("text_length"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
