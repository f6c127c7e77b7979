"""Texts that look the same but are written with different characters.

``normalise`` brings a text to one form for comparisons: compatibility composition, full case folding,
white space mapped to single kinds, default-ignorable characters removed, and look-alike letters of Latin,
Cyrillic and Greek brought to one of them. ``appearance`` is the finer form behind pairs that look alike: it
keeps case, accents, raised and circled digits, line breaks and the number of spaces. The finer form
determines the coarser one, so texts of one appearance always meet under their normal form.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut

# Letters of the same shape. Each row names two scripts and gives their letters, the second taken for the first.
SAME_SHAPE = (
    # Latin, Cyrillic
    ("ABCEGHIJKMOPQSTVWXYÆƏƐƷ", "АВСЕԌНІЈКМОРԚЅТѴԜХҮӔӘԐӠ"),
    ("acdehijlopqsvwxyæəɛʒ", "асԁеһіјӏорԛѕѵԝхуӕәԑӡ"),
    ("Iy", "Ӏү"),
    # Latin small capitals, Cyrillic
    ("ʙɢʜᴋᴍᴛᴙ", "вԍнкмтя"),
    # Latin, Greek
    ("ABCEFHIJKMNOPTXYZÞɅ", "ΑΒϹΕϜΗΙͿΚΜΝΟΡΤΧΥΖϷΛ"),
    ("M", "Ϻ"),
    ("cjopvɑɛɣɩþᴋ", "ϲϳορναεγιϸκ"),
    # Greek, Cyrillic (letters without a Latin twin)
    ("ΓΘΠΦΨͶᴦᴨ", "ГѲПФѰИгп"),
)


def _twins() -> dict[str, str]:
    """Each letter to the one that stands for its shape."""
    to: dict[str, str] = {}
    for kept, taken in SAME_SHAPE:
        for k, t in zip(kept, taken, strict=True):
            if k != t:
                to[t] = to.get(k, k)
    return {t: to.get(k, k) for t, k in to.items()}


LOOKALIKES = _twins()
# Ranges of characters that are shown as nothing (default-ignorable).
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_BLANKS = re.compile(r"[^\S\n\r]")


@lru_cache(maxsize=65_536)
def _shape(ch: str) -> str:
    """A character's form by appearance: nothing, a space, or its usual form (full-width, joined letters)."""
    code = ord(ch)
    if any(low <= code <= high for low, high in IGNORABLE):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in LOOKALIKES:  # before the compatibility form, which takes some by their meaning
        return LOOKALIKES[ch]
    kind, _, parts = unicodedata.decomposition(ch).partition(" ")
    letters = "".join(chr(int(x, 16)) for x in parts.split())
    if kind in ("<wide>", "<narrow>"):
        return letters
    if kind == "<compat>" and unicodedata.category(ch)[0] == "L" and letters and all(unicodedata.category(x)[0] in "LM" for x in letters):
        return unicodedata.normalize("NFKC", ch)
    return ch


def _seen(match: re.Match[str]) -> str:
    return "".join(map(_shape, match.group()))


def appearance(text: str) -> str:
    """The text by its looks; equal for two texts if and only if they look the same."""
    if text.isascii():
        return text
    apart = unicodedata.normalize("NFD", _NOT_ASCII.sub(_seen, text))
    return unicodedata.normalize("NFC", _NOT_ASCII.sub(lambda m: "".join([LOOKALIKES.get(c, c) for c in m.group()]), apart))


def normalise(text: str) -> str:
    """The text in its one form for comparisons, a function of its appearance."""
    return normal_of_appearance(appearance(text))


def normal_of_appearance(look: str) -> str:
    if look.isascii():
        return _BLANKS.sub(" ", look.lower())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", look).casefold())
    return _BLANKS.sub(" ", folded)


def normalised_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, normal string) of each row; null stays null. Worked out once per distinct value of a batch."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = {t: normalise(t) for t in batch["t"].unique() if t is not None}
            yield pd.DataFrame({"k": batch["k"], "normal": batch["t"].map(forms)})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, normal string").select(F.col("k").alias(key), "normal")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, normal_h, look_h, text_h) of each text that is not null: 128-bit hashes of its forms and of itself."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = {}
            for t in batch["t"].unique():
                look = appearance(t)
                own = _digest(t)
                forms[t] = (_digest(normal_of_appearance(look)), own if look is t or look == t else _digest(look), own)
            rows = [forms[t] for t in batch["t"]]
            out = pd.DataFrame(rows, columns=["normal_h", "look_h", "text_h"], dtype=object)
            out.insert(0, "k", batch["k"].to_numpy())
            yield out

    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, normal_h binary, look_h binary, text_h binary").select(F.col("k").alias(key), "normal_h", "look_h", "text_h")


def lookalike_pairs(df: DataFrame, key: str, text: str, a: str = "key_a", b: str = "key_b") -> DataFrame:
    """(key_a, key_b) of rows whose texts differ as character sequences but look the same, key_a < key_b.

    Texts are hashed once. Different texts that share their normal form and their appearance are paired, each text once
    whatever its copies; then the pairs of texts are spread to the rows that have them. So exact copies, however many,
    make no pairs among themselves. Null keys and texts make none. Repeated deliveries of a row come out once.
    """
    rows = cut(fingerprints(df, key, text))
    forms = ["normal_h", "look_h"]
    groups = rows.groupBy(*forms).agg(F.min("text_h").alias("lo"), F.max("text_h").alias("hi")).where("lo <> hi").select(*forms)
    held = cut(rows.join(cut(groups), forms, "left_semi"))
    texts = cut(held.select(*forms, "text_h").dropDuplicates())
    pairs = texts.withColumnRenamed("text_h", "text_x").join(texts.withColumnRenamed("text_h", "text_y"), forms).where("text_x < text_y").select("text_x", "text_y")
    own = lambda at: held.select(F.col("text_h").alias(f"text_{at}"), F.col(key).alias(f"_{at}"))
    met = pairs.join(own("x"), "text_x").join(own("y"), "text_y").where("_x <> _y")
    return met.select(F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b)).dropDuplicates()
