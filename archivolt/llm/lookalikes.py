"""Visually identical text with different characters (problem 10).

DuckDB runs inside each Arrow partition: one embedded SQL expression brings a text to its form by regular expressions,
``nfc_normalize`` and ``translate``. Only texts with a character beyond ASCII take that way; ASCII text is its own form.

What does not change the look is mapped: width forms and positional forms, Latin ligatures, separate accents, kinds of
blank and hyphen, invisible characters, and letters of other scripts that have a Latin letter's shape. What does is
kept: superscripts, fractions, signs such as the numero sign, dashes, line breaks, styled letters (mathematical bold and
the like), overrides of the writing direction, and the joiner inside an emoji.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.plans.runtime import cut, spread

#: Letters of other scripts, each with the Latin letter of its shape.
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C"}
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ӏ": "I", "ӏ": "l"}
ARMENIAN = {"Օ": "O", "օ": "o", "ս": "u", "հ": "h", "Տ": "S", "Լ": "L", "ո": "n", "ց": "g", "զ": "q"}
CHEROKEE = {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"}
#: Hyphens, and characters that are not seen. The joiner U+200D is treated apart.
HYPHENS = "\u2010\u2011\ufe63"
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200e\u200f\u202a\u202b\u202c\u2060-\u2064\u2066-\u206f\ufeff\u115f\u1160\u3164\uffa0\U000e0000-\U000e007f"
#: Ligatures and what they stand for: the block of Latin and Armenian ones.
LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18))}
#: Blocks that hold emoji; a joiner between two of these characters (or selectors) belongs to the picture.
EMOJI = "\u2190-\u21ff\u2600-\u27bf\u2b00-\u2bff\ufe0f\U0001f000-\U0001faff"
_WIDTH = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>")


def character_map() -> dict[str, str]:
    """Every character that stands for another single one, by rule from the Unicode tables and the lists above."""
    out = {}
    shapes = GREEK | CYRILLIC | ARMENIAN | CHEROKEE
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        form = unicodedata.decomposition(c)
        to = c
        if form.startswith(_WIDTH):
            to = unicodedata.normalize("NFKC", c)
        elif unicodedata.category(c) == "Zs":
            to = " "
        elif c == "µ":
            to = "μ"
        if len(to) == 1 and unicodedata.name(to, "").startswith(("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")):
            base, *marks = unicodedata.normalize("NFD", to)
            to = unicodedata.normalize("NFC", shapes.get(base, base) + "".join(marks)) if base in shapes else to
        if to != c and len(to) == 1:
            out[c] = to
    return out | dict.fromkeys(HYPHENS, "-")


def form_sql(column: str) -> str:
    """The SQL expression of a text's form."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    mapping = character_map()
    wide = f"regexp_replace({column}, {quote(f'[{INVISIBLE}]')}, '', 'g')"
    # a joiner is dropped unless the character before it and the one behind it are emoji
    joined = f"case when contains({column}, '\u200d') then regexp_replace(regexp_replace(regexp_replace(w, {quote(f'([{EMOJI}])\u200d+([{EMOJI}])')}, '\\1\ue000\\2', 'g'), '\u200d', '', 'g'), '\ue000', '\u200d', 'g') else w end"
    spelled = "j"
    for ligature, letters in LIGATURES.items():
        spelled = f"replace({spelled}, {quote(ligature)}, {quote(letters)})"
    spelled = f"case when regexp_matches(j, '[\ufb00-\ufb17]') then {spelled} else j end"
    final = f"nfc_normalize(translate(nfc_normalize(s), {quote(''.join(mapping))}, {quote(''.join(mapping.values()))}))"
    return (
        f"case when not regexp_matches({column}, '[^\\x00-\\x7f]') then {column} else "
        f"list_extract(list_transform(list_transform(list_transform([{wide}], lambda w: {joined}), lambda j: {spelled}), lambda s: {final}), 1) end"
    )


def _in_duckdb(select: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as db:
            for batch in batches:
                if not batch.num_rows:
                    continue
                db.register("part", pa.Table.from_batches([batch]))
                for out in db.sql(select).to_arrow_table().combine_chunks().to_batches():
                    yield out.select(names)
                db.unregister("part")

    return run


def canonical_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` in its one form. Null texts stay null, empty texts empty; blanks are kept as they are
    counted, each as a space, and line breaks as they are. Repeated rows are kept."""
    sql = f"select id, {form_sql('text')} as text from part"
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_in_duckdb(sql, ["id", "text"]), f"id {kind}, text string")


def form_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``look`` (128-bit hash of the form) and ``raw`` (of the text). Null texts and texts that show nothing
    but blanks are left out."""
    sql = f"""select id, unhex(md5(form)) look, unhex(md5(text)) raw from (select id, text, {form_sql('text')} form from part where text is not null)
        where regexp_matches(form, '[^\\s]')"""
    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(_in_duckdb(sql, ["id", "look", "raw"]), f"id {kind}, look binary, raw binary")


def look_classes(keys: DataFrame) -> DataFrame:
    """One row per document: ``id``, ``class_id`` (smallest id of the texts that look the same) and ``copies``."""
    groups = keys.groupBy("look").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return keys.join(groups, "look").select("id", "class_id", "copies")


#: Distinct texts of one look that meet in one task.
BLOCK = 1_000


def lookalike_pairs(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id_a`` < ``doc_id_b``: the pairs whose texts look the same and are not equal character for character.

    This expands :func:`look_classes`, the form that scales, to the pairs that are asked for, and is as large as they
    are many. Pairs are formed between the distinct texts of a look, then expanded to the documents, so copies to the
    letter never meet. A look of more than ``block`` distinct texts is cut into blocks by hash, each of which meets
    the look's texts in a task of its own. A look with one distinct text, however often it occurs, costs one row per
    task. Ids are taken as unique; a null id is left out. The keys, 40 bytes a text, are materialised, so that no text
    is read twice.
    """
    keys = cut(keys.where(F.col("id").isNotNull()))
    texts = keys.groupBy("look", "raw").agg(F.count("*").alias("n"))
    varied = texts.groupBy("look").agg(F.count("*").alias("texts")).where("texts > 1").select("look", F.ceil(F.col("texts") / block).cast("int").alias("blocks"))
    members = keys.join(varied.select("look"), "look", "left_semi")
    kinds = members.select("look", "raw").distinct().join(varied, "look")
    own = kinds.select("look", "raw", F.pmod(F.xxhash64("raw"), "blocks").cast("int").alias("block"))
    others = kinds.select("look", F.col("raw").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = own.join(others, ["look", "block"]).where("raw < other").select("look", "raw", "other")
    left = members.select("look", "raw", F.col("id").alias("x"))
    right = members.select("look", F.col("raw").alias("other"), F.col("id").alias("y"))
    both = pairs.join(left, ["look", "raw"]).join(right, ["look", "other"])
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
