"""Spelling variant grouping: one-edit neighbourhoods over a reduced alphabet, verified on the words themselves."""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: The letters of words: a-z, A-Z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Symbols that letters are hashed to. With few, many words share a reduced word; with many, neighbourhoods are large.
SYMBOLS = 8
#: The base of reduced words as numbers: odd, so that it can be divided by. Letters of words that travel with their keys at
#: most, and letters that are hashed at a time.
BASE, LONG, SLICE = np.uint64(0x9E3779B97F4A7C15), 64, 200_000
#: Least code points of a word, least occurrences, and how many times more frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a letter, where ``word_counts`` is told to.
DAMAGE = 31
#: Rounds in which chains of forms are halved: a form has RATIO times the occurrences, so a chain has at most 19 links.
ROUNDS = 6


def _symbol_table(symbols: int) -> tuple[str, str]:
    """Letters and the symbol of each, by a hash of the letter."""
    letters = string.ascii_letters + "".join(map(chr, range(0xC0, 0x100)))
    return letters, "".join(chr(ord("1") + zlib.crc32(c.encode()) % symbols) for c in letters)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with every letter replaced by one of few symbols."""
    return F.translate(word, *_symbol_table(symbols))


def neighbourhoods(words: list[str], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, replaced, counts, deleted) for words of one length: hashes of the reduced words and of their neighbourhoods.

    A reduced word is the number sum(symbol at i * BASE^i) modulo 2^64, so a neighbour differs by a term, and a deletion shifts what
    follows by one power; a word of any length costs a few numbers a letter. Of the full neighbourhood each edge is made at
    one of its ends only: the longer word deletes a symbol, which stands for the insertion into the shorter, and of a
    replacement the word with the smaller symbol takes the larger ones. ``replaced`` is flat, ``counts`` of it per word.
    """
    letters, to = _symbol_table(symbols)
    table = np.zeros(256, np.uint64)
    table[[ord(c) for c in letters]] = [ord(c) - ord("0") for c in to]
    s = table[np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(s.shape[1] - 1, BASE, np.uint64)], dtype=np.uint64)
        upto = np.cumsum(s * powers, axis=1, dtype=np.uint64)
        own = upto[:, -1]
        larger = np.arange(2, symbols + 1, dtype=np.uint64)
        more = larger > s[:, :, None]
        replaced = (own[:, None, None] + (larger - s[:, :, None]) * powers[:, None])[more]
        deleted = upto - s * powers + (own[:, None] - upto) * np.uint64(pow(int(BASE), -1, 1 << 64))
    return own, replaced, more.sum((1, 2)), deleted


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, with at least so many code points and occurrences.

    If ``damage`` is not 0 and divides the CRC-32 of ``<id>:<run>``, that run loses the letter at CRC mod length: misspelled
    words whose originals are known. A null id counts as an empty one. Counts are combined in each task before the shuffle.
    """
    runs = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("word"))
    runs = runs.select("doc", F.translate("word", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if damage:
        crc = F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))
        runs = runs.select("word", crc.alias("crc"), F.char_length("word").alias("length"))
        gone = (F.col("crc") % F.col("length")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), gone), F.substring("word", gone + 2, F.col("length")))
        runs = runs.select(F.when(F.col("crc") % damage == 0, cut).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _hashed(words: DataFrame, symbols: int, around: bool) -> DataFrame:
    """``words`` with ``own``, and if ``around`` the lists ``replaced`` and ``deleted`` of ``neighbourhoods``, as longs."""

    def run(batches):
        for batch in batches:
            size = np.array([len(w) for w in batch.column("word").to_pylist()])
            for length in np.unique(size):
                at = np.flatnonzero(size == length)
                step = max(1, SLICE // int(length))
                for lo in range(0, len(at), step):
                    part = batch.take(pa.array(at[lo : lo + step]))
                    own, replaced, counts, deleted = (x.view(np.int64) for x in neighbourhoods(part.column("word").to_pylist(), symbols))
                    lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(v.ravel())) for n, v in ((counts, replaced), (np.full(len(part), length), deleted))]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own), *lists[: 2 * around]], names=[*part.schema.names, "own", *("replaced", "deleted")[: 2 * around]])

    return arrow_map(words.select("word", "n"), run, "word string, n long, own long" + ", replaced array<long>, deleted array<long>" * around)


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, a_n, b, b_n) for each two of ``words`` (word, n) that differ by one inserted, deleted or replaced code point.

    Words that do so have reduced words that are equal or one edit apart, so the neighbourhood of one holds the reduced word
    of the other. Pairs that meet under a key are verified on the words and their reduced words, so that hashes decide
    nothing and each pair comes once. Keys are joined by shuffle, so a reduced word that very many words share can be
    split. With the keys of words over ``LONG`` letters a digest travels in place of the word.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), keys.alias("keys")) for k, keys in enumerate((F.array("own"), F.array_distinct("replaced"), F.array_distinct("deleted")))])
    size = F.char_length("word")

    def side(rows, name, *more):
        return rows.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), *more)

    def keys(rows, *kept):
        return rows.select(*kept, F.explode(kinds).alias("k")).select(*kept, "k.kind", F.explode("k.keys").alias("key"))

    a, b = reduced(F.col("a"), symbols), reduced(F.col("b"), symbols)
    longer = F.char_length("a") - F.char_length("b")
    fits = F.when(F.col("kind") == 0, (a == b) & (F.col("a") < F.col("b"))).when(F.col("kind") == 1, (a < b) & (longer == 0)).otherwise(longer == 1)
    near = fits & (F.levenshtein("a", "b", 1) == 1)
    few, named = words.where(size <= LONG), words.where(size >= LONG)
    met = keys(side(_hashed(few, symbols, True), "a", "own", "replaced", "deleted"), "a", "a_n").join(side(_hashed(few, symbols, False), "b", F.col("own").alias("key")), "key").where(near)
    digest = F.unhex(F.sha2("word", 256))
    long = keys(_hashed(named.where(size > LONG), symbols, True).withColumn("a_digest", digest), "a_digest").join(_hashed(named, symbols, False).select(F.col("own").alias("key"), digest.alias("b_digest")), "key")
    long = long.join(side(named, "a", digest.alias("a_digest")), "a_digest").join(side(named, "b", digest.alias("b_digest")), "b_digest").where(near)
    return met.select("a", "a_n", "b", "b_n").unionByName(long.select("a", "a_n", "b", "b_n"))


def variant_groups(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    ``form`` is the near word with the most occurrences, of equals the first in code-point order, if it has ``ratio`` times
    the word's own; else null. ``root`` is where the forms lead: the chain is halved in each round, and as counts grow by
    ``ratio`` in every link, the rounds are few at any size. Only minima and counts are aggregated, so a word with very many
    near ones is combined before the shuffle.
    """
    pairs = near_words(words, symbols)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("to"), F.col("b_n").alias("to_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("to"), F.col("a_n").alias("to_n")))
    both = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("to_n")).alias("less"), "to")).alias("best"))
    per = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    per = materialize(per.select("word", "n", "n_near", F.col("best.to").alias("form"), (-F.col("best.less")).alias("form_n")), "word-forms")
    roots = per.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialize(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        roots = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    return per.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", damage: int = DAMAGE) -> DataFrame:
    """``variant_groups`` of the words of all documents.

    Null and empty texts have no words; words are counted in whole texts, however long. Rows that repeat an id or a text
    count each. Of words with equal counts the first in code-point order is the form. An empty table gives no rows, and
    other columns are ignored.
    """
    return variant_groups(materialize(word_counts(docs, id, text, damage=damage), "words"))
