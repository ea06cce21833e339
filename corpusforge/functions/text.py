"""String functions over columns; all built-in, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code-point ranges of the scripts that a pruned vocabulary drops.
SCRIPTS = (
    (0x0400, 0x052F),  # Cyrillic
    (0x0590, 0x05FF),  # Hebrew
    (0x0600, 0x08FF),  # Arabic and extensions
    (0x0900, 0x0DFF),  # Indic blocks
    (0x0E00, 0x0E7F),  # Thai
    (0x1100, 0x11FF),  # Hangul Jamo
    (0x3040, 0x30FF),  # Hiragana and Katakana
    (0x3130, 0x318F),  # Hangul compatibility Jamo
    (0x3400, 0x4DBF),  # CJK extension A
    (0x4E00, 0x9FFF),  # CJK unified ideographs
    (0xAC00, 0xD7AF),  # Hangul syllables
    (0xF900, 0xFAFF),  # CJK compatibility ideographs
)
SPACE_MARK = "▁"


def utf8_bytes(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def byte_hex(c: Column) -> Column:
    """UTF-8 bytes as two hex digits each."""
    return F.hex(F.encode(c, "UTF-8"))


def is_byte_piece(c: Column) -> Column:
    return c.rlike(r"\A<0x[0-9A-F]{2}>\z")


def is_unused(c: Column) -> Column:
    return c.rlike(r"\A<unused[0-9]+>\z")


def is_control(c: Column) -> Column:
    return c.startswith("<|") | c.endswith("|>")


def is_atom(c: Column) -> Column:
    """One code point, or a byte piece: what needs no merge."""
    return (F.char_length(c) == 1) | is_byte_piece(c)


def has_foreign_script(c: Column) -> Column:
    return c.rlike("[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in SCRIPTS) + "]")


def is_run_of(c: Column, char: str) -> Column:
    return (F.char_length(c) > 0) & (F.translate(c, char, "") == "")


def piece_bytes(c: Column) -> Column:
    """Bytes that a piece decodes to: one for a byte piece, else UTF-8 with the space mark as a space."""
    return F.when(is_byte_piece(c), F.lit(1)).otherwise(F.octet_length(F.replace(c, F.lit(SPACE_MARK), F.lit(" ")))).cast("long")


def prompt(user: Column, assistant: Column) -> Column:
    return F.concat(F.lit("User: "), user, F.lit("\nAssistant: "), assistant)


def with_answer_cue(raw: Column) -> Column:
    """A prompt that ends with the cue for an answer, unless it has one already."""
    return F.when(raw.contains("Assistant:"), raw).otherwise(F.concat(F.regexp_replace(raw, r"(?U)\s+\z", ""), F.lit("\nAssistant: ")))


def shard_name(prefix: str, split: Column, index: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), split, F.lit("_"), F.lpad(index.cast("string"), 6, "0"), F.lit(".bin"))


#: Fixed value: the public split pattern of byte-level tokenizers; (?U) gives \s its Unicode meaning in Java.
PRETOKEN = r"(?U)'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


def pretokens(c: Column) -> Column:
    """The text's pieces in order; joined, they give the text back."""
    return F.regexp_extract_all(c, F.lit(PRETOKEN), F.lit(0))
