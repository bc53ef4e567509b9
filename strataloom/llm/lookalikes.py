"""Visually identical text with different characters, brought to one form by DuckDB inside Arrow partitions.

The form of a text is one SQL statement (``form_select``): invisible characters go, every space becomes the ordinary
one and every line break a line feed, width and font variants, ligatures and look-alike letters become the letters
they look like, and what remains is composed (NFC). Variants come from Unicode's compatibility decompositions by rule
(``variants``: wide, narrow and font ones, letters made of letters); super- and subscripts, circled, squared and
small forms, fractions and variants of another shape (the long s, Greek symbol letters) look different and stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import cut, spread

# Letters and letter-like signs of the same shape as an ASCII letter (left) and that letter (right).
LOOK = {
    # Cyrillic, capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Һ": "h", "Ӏ": "I", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    # Cyrillic, small
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ϳ": "j", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϒ": "Y",
    # Armenian, Cherokee, Coptic
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "Տ": "S", "Օ": "O", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ⲟ": "o", "Ⲟ": "O", "ⲣ": "p", "Ⲣ": "P", "Ⲥ": "C", "ⲥ": "c",
    # Others
    "∣": "|", "ɡ": "g", "ɑ": "a",
}
# Letters and letter-like signs of the same shape as one that is not ASCII (left) and that one (right), which
# is the one that is composed with accents, where any is, and is itself mapped to nothing.
LOOK_OTHER = {
    # Greek and Cyrillic
    "Γ": "Г", "П": "Π", "Ф": "Φ", "Ѱ": "Ψ", "ѱ": "ψ", "Ͷ": "И", "ͷ": "и", "ϴ": "Θ",
    # Cyrillic or Greek and Latin
    "Ə": "Ә", "ə": "ә", "ǝ": "ә", "Ɵ": "Ө", "Ѳ": "Ө", "ɵ": "ө", "ѳ": "ө", "Ӕ": "Æ", "ӕ": "æ", "Ӡ": "Ʒ", "ӡ": "ʒ", "Ԑ": "Ɛ", "ԑ": "ɛ",
    "Ͻ": "Ɔ", "ͻ": "ɔ",
    # Coptic, Cherokee, small capitals
    "Ⲅ": "Г", "Ⲡ": "Π", "Ⲫ": "Φ", "Ꮁ": "Г", "ᴨ": "п", "ᴫ": "л", "κ": "к", "ĸ": "к",
    # Letter-like signs
    "\u00b5": "\u03bc", "∆": "Δ", "∏": "Π", "∑": "Σ", "Ʃ": "Σ", "ℵ": "א", "ℶ": "ב", "ℷ": "ג", "ℸ": "ד",
}
# Characters without a glyph or width (the emoji joiner aside, which changes what is seen).
INVISIBLE = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
    r"\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{0084}\x{0086}-\x{009F}"
)
# Spaces of any kind and width.
SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{2800}\x{3000}"
# Pictographs, between which a joiner makes one picture of two.
PICTO = r"\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}"
KEPT_JOINER = "chr(64976)"  # a code point that no text may hold


# Where letters made of letters are found: Latin digraphs and ligatures, Roman numerals, Hebrew and Armenian ligatures.
LETTER_COMPOUNDS = (*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180), *range(0xFB00, 0xFB18), 0xFB4F)


@lru_cache(1)
def variants() -> dict[str, str]:
    """Width and font variants and letters made of letters, each with what it looks like, by Unicode's decompositions."""
    out: dict[str, str] = {}
    for cp in range(0x80, 0x110000):
        d = unicodedata.decomposition(chr(cp)).split()
        if not d or d[0][0] != "<" or chr(cp) in "\u3164\uffa0":
            continue
        if d[0] in ("<wide>", "<narrow>", "<font>") or (d[0] == "<compat>" and cp in LETTER_COMPOUNDS):
            out[chr(cp)] = "".join(chr(int(x, 16)) for x in d[1:])
    return out


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Every character that looks like others, with these: variants, look-alikes, and composed letters on them."""
    single = {a: b for a, b in (LOOK | LOOK_OTHER).items() if a != b}
    # a variant may itself stand for a look-alike, and a compound hold one
    out = {a: "".join(single.get(c, c) for c in variants().get(b, b)) for a, b in variants().items()} | single
    for cp in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        ch = unicodedata.normalize("NFD", chr(cp))
        if len(ch) > 1 and any(c in out for c in ch):
            out[chr(cp)] = unicodedata.normalize("NFC", "".join(out.get(c, c) for c in ch))
    return {a: unicodedata.normalize("NFC", b) for a, b in out.items()}


@lru_cache(1)
def tables() -> tuple[str, str]:
    """The translation's characters, from and to."""
    pairs = {a: b for a, b in mapping().items() if len(b) == 1}
    return "".join(pairs), "".join(pairs.values())


def plain_sql(col: str) -> str:
    """A text without invisible characters, with one kind of space and of line break, composed."""
    joined = f"([{PICTO}]\\x{{FE0F}}?[\\x{{1F3FB}}-\\x{{1F3FF}}]?)\\x{{200D}}([{PICTO}])"
    hold = f"'\\1' || {KEPT_JOINER} || '\\2'"
    kept = f"regexp_replace(regexp_replace({col}, '{joined}', {hold}, 'g'), '{joined}', {hold}, 'g')"
    bare = f"replace(regexp_replace({kept}, '[{INVISIBLE}]', '', 'g'), {KEPT_JOINER}, chr(8205))"
    lines = f"regexp_replace({bare}, '\\x{{000D}}\\x{{000A}}|[\\x{{000D}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    return f"nfc_normalize(regexp_replace({lines}, '[{SPACES}]', ' ', 'g'))"


def _class(chars: str) -> str:
    """A regular expression's class of characters, in ranges."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def form_select(source: str, keep: tuple[str, ...], col: str) -> str:
    """The SELECT that gives ``keep`` and ``f``, the form of ``col``, for every row of a source. Null stays null.

    A text of ASCII without control characters is its own form. Of the map each block is applied only to texts that
    hold some of it, as most of it is rare.
    """
    rest = "".join(f"{k}, " for k in keep)
    settled = f"strlen({col}) = length({col}) AND NOT regexp_matches({col}, '[\\x{{0000}}-\\x{{0008}}\\x{{000B}}-\\x{{001F}}\\x{{007F}}]')"
    out = f"SELECT {rest}s, CASE WHEN s THEN {col} ELSE {plain_sql(col)} END AS f FROM (SELECT *, {settled} AS s FROM {source})"
    quoted = lambda t: t.replace("'", "''")
    a, b = tables()
    rare = lambda c: ord(c) > 0xFFFF or 0xFB00 <= ord(c) < 0xFF00 or 0x2100 <= ord(c) < 0x2190 or 0x1F00 <= ord(c) < 0x2000
    for block in (lambda c: not rare(c) and ord(c) < 0xFF00, lambda c: not rare(c) and ord(c) >= 0xFF00, rare):
        x = "".join(c for c in a if block(c))
        y = "".join(d for c, d in zip(a, b) if block(c))
        out = f"SELECT {rest}s, CASE WHEN NOT s AND regexp_matches(f, '{_class(x)}') THEN translate(f, '{quoted(x)}', '{quoted(y)}') ELSE f END AS f FROM ({out})"
    several = {x: y for x, y in mapping().items() if len(y) > 1}
    chain = "f"
    for x, y in several.items():
        chain = f"replace({chain}, '{quoted(x)}', '{quoted(y)}')"
    out = f"SELECT {rest}s, CASE WHEN NOT s AND regexp_matches(f, '{_class(''.join(several))}') THEN {chain} ELSE f END AS f FROM ({out})"
    return f"SELECT {rest}CASE WHEN s THEN f ELSE nfc_normalize(f) END AS f FROM ({out})"


def forms(df: DataFrame, key: str, text: str, column: str = "form") -> DataFrame:
    """``key`` and the text's form, one row per input row; whole texts, whatever their length.

    Null keys and null texts are kept (a null text has a null form). Only these two columns are read, so other
    columns cannot clash.
    """
    schema = T.StructType([df.schema[key], T.StructField(column, T.StringType())])
    formed = form_select("part", ("n",), "t")

    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": True})
        for b in batches:
            part = pa.table({"t": b.column(1), "n": pa.array(range(b.num_rows), pa.int32())})  # noqa: F841
            got = con.sql(f"SELECT f FROM ({formed}) ORDER BY n").fetch_arrow_table().column("f").combine_chunks()
            yield pa.RecordBatch.from_arrays([b.column(0), got.cast(pa.string())], schema=out)

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__t")).mapInArrow(run, schema)


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each visible text's class: ``doc_id, text_hash, class_id`` (128 bits of the SHA-256 of the text and of its form)."""
    schema = T.StructType([df.schema[key], T.StructField("text_hash", T.BinaryType()), T.StructField("class_id", T.BinaryType())])
    formed = form_select("part", ("k", "t"), "t")

    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": True})
        for b in batches:
            part = pa.table({"k": b.column(0), "t": b.column(1)})  # noqa: F841
            got = con.sql(
                f"SELECT k, unhex(substr(sha256(t), 1, 32)) AS h, unhex(substr(sha256(f), 1, 32)) AS c FROM ({formed}) "
                "WHERE regexp_matches(f, '\\S')"
            ).fetch_arrow_table()
            for rb in got.to_batches():
                yield pa.RecordBatch.from_arrays([rb.column(i).cast(out.field(i).type) for i in range(3)], schema=out)

    src = spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__t")).where("__t is not null"))
    return src.mapInArrow(run, schema).withColumnRenamed(key, "doc_id")


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``doc_id_a < doc_id_b`` of different texts that look the same.

    Texts are compared, not documents: classes with more than one text are found by a pre-aggregated least and
    greatest text, and only their documents go on. Their texts (each once, however many copies it has) are paired,
    and documents joined to the paired texts, so copies never meet each other. The texts of a class are dealt to as
    many pieces as it has thousands, so the pairs of a class with very many spellings come from many tasks. Null
    texts and texts without a visible character are in no pair; null keys neither. ``classes`` gives the same links
    without expanding them into pairs.
    """
    doc = cut(classes(df, key, text).where("doc_id is not null"))
    several = doc.groupBy("class_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi")
    inside = cut(doc.join(several.select("class_id"), "class_id", "left_semi").distinct())
    texts = inside.select("class_id", "text_hash").distinct()
    pieces = texts.groupBy("class_id").agg(F.ceil(F.count("*") / 1000).cast("int").alias("pieces"))
    texts = cut(texts.join(pieces, "class_id"))
    a = texts.select("class_id", F.col("text_hash").alias("a"), F.pmod(F.xxhash64("text_hash"), "pieces").cast("int").alias("piece"))
    b = texts.select("class_id", F.col("text_hash").alias("b"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    pairs = a.join(b, ["class_id", "piece"]).where("a < b").select("a", "b")
    da = inside.select(F.col("text_hash").alias("a"), F.col("doc_id").alias("x"))
    db = inside.select(F.col("text_hash").alias("b"), F.col("doc_id").alias("y"))
    return (
        pairs.join(da, "a").join(db, "b").where("x <> y")
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    )
