"""Text that was decoded with the wrong encoding: found and restored.

The corpus' distinct words with a character beyond ASCII are counted. For every
distinct word its garbled forms under all encoding chains (one wrong decoding,
UTF-8 taken for another encoding twice or three times, and losses: undefined
bytes replaced or dropped) are generated, and the words of the documents are
hash-joined with this table. A word is garbled if it is such a form of a word
that more different texts have, or if the direction is plain (directed): its
bytes are the original in UTF-8, or symbols or letters of another script stand
among its letters where the original has letters of one script only. A plain direction holds whatever the counts, as
garbled texts may be the greater part. The original is the most frequent one that
is not garbled itself. Words of letters that two single-byte encodings turn into
each other have no plain direction: there the counts alone decide. All
encodings used leave ASCII alone, so a word is a run of ASCII letters, digits and
characters beyond ASCII with its numbers masked; of words with a symbol
(quotation mark, dash, currency) a second form with ASCII letters masked also
counts, so that rare names beside a garbled apostrophe are covered.

A document is listed if it has a garbled word of at least three letters or two
characters beyond ASCII, or a word with a replacement or C1 control character
(loss beyond restoring). A sample that stands alone between quotation marks is
another word than the sample itself and is thereby left out; of sentences that
explain garbling (EXPLAINING) the SAMPLEs are left out, too, and only these.

Plan: two scans. Word counts combine on the map side; generated forms are
filtered by a bitmap of bounded size of the words that occur at all before they are
shuffled; document words go as 8-byte hashes, distinct in each document.

Defined results: NULL and empty texts are no case; repeated rows count once; an
empty table gives an empty one; other columns are ignored; texts are read whole;
ties between originals of equal frequency go to the smaller one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.llm.common import join_few
from weblens.session import write_shared

SINGLE = ["cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852"]
TWICE = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866"]
#: Bits of the bitmap for each distinct word, and fewest and most bits; beyond the most it passes more forms on, and none is lost.
BITS_PER_WORD, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
#: Words of which forms are generated at once in a task.
_AT_ONCE = 500
#: What is between words: runs of ASCII other than letters and digits.
_BETWEEN = "[\\x00-/:-@\\[-`{-\\x7f]+"
_LOST = re.compile("[\x80-\x9f\xad�]")
_LOSS = "[\\x{80}-\\x{9f}\\x{fffd}]"


#: Words of a sentence that shows a garbled sample to explain it; SIGNS are parts of which every such sentence has one.
EXPLAINING = (
    r"(?iu)\bexample of\b|\bwrong(?:ly)? (?:read|decoded|encod)|\bcharsets?\b|\bcharacter sets?\b|\bencodings?\b|\bmojibake\b|\bmis-?(?:read|decoded)\b|\bgarbled\b"
    r"|zeichensatz|zeichenkodierung|\bencodage\b|codificaci[oó]n|codifica[cç][aã]o|кодировк|kodowani|pengodean"
)
#: In small letters, looked for in the lower-cased text.
SIGNS = ["example of", "wrong", "charset", "character set", "encod", "mojibake", "misread", "mis-read", "misdecoded", "mis-decoded", "garbled", "zeichensatz", "zeichenkodierung", "codifica", "кодировк", "kodowani", "pengodean"]


#: Samples in a sentence that explains: quoted, of characters beyond ASCII alone, or the word beside "an example of".
SAMPLE = (
    r"“[^“”\n]{0,60}”|„[^“”„\n]{0,60}[“”]|«[^«»\n]{0,60}»|‘[^‘’\n]{0,60}’|\"[^\"\n]{0,60}\"|`[^`\n]{0,60}`|(?<!\w)'[^'\n]{1,60}'(?!\w)"
    r"|(?<![^\s(\[/:,;=])[^\x00-\x7f]{1,8}(?![^\s)\]/:,.;=!?])|\S+(?=\s+(?:(?:as|is|was)\s+)?(?i:an example of\b))|(?i:(?<=\bexample of ))(?:an?\s+)?\S+"
)


def evidence(text: Column) -> Column:
    """text without the samples of sentences that explain garbling; their other words stay."""

    def some(lower: Column) -> Column:
        out = lower.contains(SIGNS[0])
        for sign in SIGNS[1:]:
            out = out | lower.contains(sign)
        return out

    parts = F.split(text, r"\n|(?<=[.!?])\s+(?=\p{Lu})")
    return F.when(F.exists(F.array(F.lower(text)), some), F.array_join(F.transform(parts, lambda x: F.when(x.rlike(EXPLAINING), F.regexp_replace(x, SAMPLE, " ")).otherwise(x)), "\n")).otherwise(text)


def words(text: Column) -> Column:
    """ARRAY<STRING>: distinct words with a character beyond ASCII, numbers masked."""
    beyond = F.filter(F.split(text, _BETWEEN), lambda w: w.rlike("[\\x{80}-\\x{10ffff}]"))
    return F.array_distinct(F.transform(beyond, lambda w: F.regexp_replace(w, "[0-9]+", "0")))


def symbol_form(word: Column) -> Column:
    return F.regexp_replace(word, "[A-Za-z]+", "a")


def _decode(data: bytes, name: str) -> list[str]:
    """What the bytes look like in an encoding: strictly, else with undefined bytes kept as controls, replaced or dropped."""
    try:
        return [data.decode(name)]
    except UnicodeDecodeError:
        out = [data.decode(name, "replace"), data.decode(name, "ignore")]
        if name != "utf-8":
            out.append("".join(bytes([b]).decode(name, "ignore") or chr(b) for b in data))
        return out


def garbled_forms(word: str) -> set[str]:
    """All forms that a rightly written word takes under the encoding chains."""
    out: set[str] = set()
    utf8 = word.encode("utf-8", "surrogatepass")
    for name in SINGLE:
        for first in _decode(utf8, name):
            out.add(first)
            if name in TWICE:
                for again in TWICE:
                    for second in _decode(first.encode("utf-8"), again):
                        out.add(second)
                        if again == name and name in ("cp1252", "latin-1"):
                            out.update(_decode(second.encode("utf-8"), name))
        try:
            data = word.encode(name)
        except UnicodeEncodeError:
            continue
        for other in SINGLE:
            if other != name:
                out.update(_decode(data, other))
        out.update(_decode(data, "utf-8"))
    for form in list(out):
        if _LOST.search(form) or "\xa0" in form:
            bare = re.sub("[\x80-\x9f\xad]", "", form)
            out.add(bare)
            out.update(p for p in bare.split("\xa0") if len(p) > 1)
    return {f for f in out if f != word and f and not f.isascii()}


def _repaired(word: str) -> set[str]:
    """What the word's bytes, taken in an encoding, are in UTF-8."""
    out = set()
    for name in SINGLE:
        try:
            data = b"".join(c.encode(name) if ord(c) > 0x9F or ord(c) < 0x80 else bytes([ord(c)]) for c in word)
            out.add(data.decode("utf-8"))
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return out - {word}


#: Symbols between letters, and box drawings beside one.
_SYMBOL_WITHIN = re.compile(r"(?<=[^\W\d_])[^\w\s'’‘´`·.,:;/–—-]+(?=[^\W\d_])|(?<=[^\W\d_])[\u2500-\u259f]|[\u2500-\u259f](?=[^\W\d_])")


def _scripts(word: str) -> set[str]:
    """Scripts of the word's letters, as their names begin; º and ª belong to any."""
    return {unicodedata.name(c, "").split(" ")[0] for c in word if c.isalpha() and c not in "ºª"}


def directed(form: str, original: str) -> bool:
    """Whether only form can be the garbled one of the two."""
    seen = step = {form}
    for _ in range(3):
        step = {y for x in step for y in _repaired(x)} - seen
        if original in step:
            return True
        seen = seen | step
    return original.isalnum() and len(_scripts(original)) == 1 and (len(_scripts(form)) > 1 or _SYMBOL_WITHIN.search(form) is not None)


_FORMS: dict[str, list[str]] = {}


def _forms(skeleton: str) -> list[tuple[str, ...]]:
    """Garbled forms of a word's characters beyond ASCII, ASCII runs held as private marks; kept, as few skeletons make up most words."""
    if skeleton not in _FORMS:
        if len(_FORMS) > 200_000:
            _FORMS.clear()
        _FORMS[skeleton] = sorted(garbled_forms(skeleton))
    return _FORMS[skeleton]


def _word_forms(words_: list[str], counts: list[int]) -> pd.DataFrame:
    rows = []
    for word, df in zip(words_, counts):
        # ASCII letters stay as they are in every chain, so forms are made of the word with its runs named by single capitals
        runs = re.findall("[A-Za-z0-9]+", word)
        if len(runs) <= 26:
            count = iter(range(26))
            skeleton = re.sub("[A-Za-z0-9]+", lambda m: chr(65 + next(count)), word)
            for form in _forms(skeleton):
                rows.append((re.sub("[A-Z]", lambda m: runs[ord(m[0]) - 65], form), word, df))
        else:
            rows += [(form, word, df) for form in garbled_forms(word)]
    return pd.DataFrame(rows, columns=["form", "original", "df"])


def _generated(batches: Iterator[pd.DataFrame], sent) -> Iterator[pd.DataFrame]:
    """(form, original, df, plain) of the forms that the bitmap knows, without those of which the original is plainly the garbled one."""
    bitmap = sent.value
    bits = np.uint64(len(bitmap) * 8)
    for batch in batches:
        own, counts = batch["word"].tolist(), batch["df"].tolist()
        for i in range(0, len(own), _AT_ONCE):
            out = _word_forms(own[i : i + _AT_ONCE], counts[i : i + _AT_ONCE])
            if not len(out):
                continue
            slot = pd.util.hash_array(out["form"].to_numpy(object), categorize=False) % bits
            out = out[(bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            pairs = list(zip(out["form"], out["original"]))
            out["plain"] = np.array([directed(f, w) for f, w in pairs], bool)
            yield out[out["plain"].to_numpy() | ~np.array([directed(w, f) for f, w in pairs], bool)]


def _bitmap(counted: DataFrame, bits: int) -> np.ndarray:
    """`bits` bits, one set for each word; combined in the cluster, so at most MOST_BITS / 32 rows come to the driver."""

    @F.pandas_udf(T.LongType())
    def slot_of(word: pd.Series) -> pd.Series:
        return pd.Series((pd.util.hash_array(word.to_numpy(object), categorize=False) % np.uint64(bits)).astype(np.int64))

    slot = counted.select(slot_of("word").alias("s"))
    parts = slot.groupBy((F.col("s") / 32).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits"))
    out = np.zeros(bits // 32, np.uint32)
    part = parts.toPandas()
    out[part["i"].to_numpy(np.int64)] = part["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def garbled_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, original): the garbled words of the corpus with their most likely originals."""
    spark = docs.sparkSession
    own = docs.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(F.xxhash64(text).alias("_t"), F.explode(words(F.col(text))).alias("word")).distinct()  # copies of a text count once
    counted = write_shared(own.groupBy("word").agg(F.count("*").alias("df")))
    symbols = counted.where(F.col("word").rlike("[A-Za-z]") & F.col("word").rlike("[^A-Za-z0-9\\p{L}]")).groupBy(symbol_form(F.col("word")).alias("word")).agg(F.sum("df").alias("df"))
    counted = write_shared(counted.unionByName(symbols).groupBy("word").agg(F.max("df").alias("df")))
    n = counted.count()
    sent = spark.sparkContext.broadcast(_bitmap(counted, min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_WORD * n).bit_length()))))
    schema = T.StructType([T.StructField("form", T.StringType()), T.StructField("original", T.StringType()), T.StructField("df", T.LongType()), T.StructField("plain", T.BooleanType())])
    clean = counted.where(~F.col("word").rlike(_LOSS)).repartition(max(spark.sparkContext.defaultParallelism, n // 20_000))  # generation is all the work here
    forms = clean.mapInPandas(lambda batches: _generated(batches, sent), schema)
    pairs = counted.withColumnRenamed("df", "_own").join(forms, F.col("word") == F.col("form")).where(F.col("plain") | (F.col("df") > F.col("_own"))).select("word", "original", "df").distinct()
    pairs = write_shared(pairs)
    garbled = pairs.select(F.col("word").alias("original"), F.lit(True).alias("_garbled")).distinct()
    ranked = pairs.join(garbled, "original", "left").groupBy("word").agg(F.max(F.struct(F.col("_garbled").isNull().alias("clean"), "df", "original")).alias("best"))
    return ranked.select("word", F.col("best.original").alias("original"))


def _strong(word: Column) -> Column:
    beyond = F.length(F.regexp_replace(word, "[\\x00-\\x7f]", ""))
    return ((F.length(F.regexp_replace(word, "[^\\p{L}]", "")) >= 3) & ~word.rlike("^a*[^a]a*$")) | (beyond >= 2)


def _lost(word: Column) -> Column:
    return word.rlike(_LOSS) & ~word.rlike("^[“«„].*[”»“]$")


def _each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, full, word): the words of each document, each once, in full and, where several characters beyond ASCII meet ASCII letters, in symbol form."""
    each = docs.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(key, evidence(F.col(text)).alias("_text")).select(key, F.explode(words(F.col("_text"))).alias("full"))
    # one character alone is too common for a symbol form; what has one is told by its bytes first
    two = (F.octet_length("full") - F.length("full") >= 2) & F.col("full").rlike("[A-Za-z][^\\x00-\\x7f]{2}|[^\\x00-\\x7f]{2}[A-Za-z]")
    return each.select(key, "full", F.explode(F.when(two, F.array_distinct(F.array("full", symbol_form(F.col("full"))))).otherwise(F.array("full"))).alias("word"))


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key): the documents with garbled text."""
    table = garbled_words(docs, key, text).where(_strong(F.col("word"))).select("word", F.lit(True).alias("_known"))
    return join_few(_each(docs, key, text), table, ["word"], "left", key).where(F.col("_known") | _lost(F.col("full"))).select(key).distinct()


def restored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, replaced): documents with garbled words, these replaced by their verified originals.

    replaced is the number of distinct words put right; words that only a symbol
    form explains keep their own letters and numbers. Weak words (see found) are
    put right only beside a strong one.
    """
    table = garbled_words(docs, key, text)
    hits = join_few(_each(docs, key, text), table, ["word"], "inner", key).groupBy(F.col(key).alias("_key")).agg(F.collect_set(F.struct("word", "original")).alias("_w"), F.max(_strong(F.col("word"))).alias("_sure")).where("_sure")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(text, T.StringType()), T.StructField("replaced", T.IntegerType())])
    pattern = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, w in zip(batch[key], batch[text], batch["_w"]):
                known, done = {x["word"]: x["original"] for x in w}, set()

                def put(m: re.Match, known=known, done=done) -> str:
                    if m[0].isascii():
                        return m[0]
                    masked = re.sub("[0-9]+", "0", m[0])
                    for form, run in ((masked, "[0-9]+"), (re.sub("[A-Za-z]+", "a", masked), "[A-Za-z]+|[0-9]+")):
                        if form in known:
                            kept = iter(re.findall(run, m[0]))
                            done.add(form)
                            return re.sub("0" if run == "[0-9]+" else "a|0", lambda _: next(kept, ""), known[form])
                    return m[0]

                rows.append((k, pattern.sub(put, t), len(done)))
            yield pd.DataFrame(rows, columns=[key, text, "replaced"])

    joined = docs.select(key, text).join(hits, F.col(key) == F.col("_key")).select(key, text, "_w")
    return joined.mapInPandas(mend, schema).where("replaced > 0").distinct()
