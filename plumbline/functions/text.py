"""Text recovery as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KANA, CJK = r"ぁ-ゟ゠-ヺー-ヿｦ-ﾟ", r"㐀-䶿一-鿿豈-﫿"
#: Separators of a fragment.
SEPARATORS = r"\x20　\-_./()・（）："
#: Private characters that stand for escaped ones, and that mark where codes start and end.
ASIDE, CUT = ("\ue000", "\ue001", "\ue002"), "\ue003"
PLAUSIBLE = rf"A-Za-z0-9{SEPARATORS}{KANA}{CJK}"


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]", ""))


def fragment_score(text: Column) -> Column:
    """2 for each ASCII letter or digit, 1 for a separator, 3 for kana, 4 for CJK, -8 for anything else; -10000 for nothing."""
    known = [(2, _count(text, "A-Za-z0-9")), (1, _count(text, SEPARATORS)), (3, _count(text, KANA)), (4, _count(text, CJK))]
    total = sum((w * n for w, n in known[1:]), known[0][0] * known[0][1])
    other = F.length(text) - sum((n for _, n in known[1:]), known[0][1])
    return F.when(F.length(text) == 0, F.lit(-10000)).otherwise(total - 8 * other)


def best_fragment(text: Column) -> Column:
    """The best-scoring stretch of plausible characters, trimmed; of equal ones the first; null without any."""
    parts = F.filter(F.transform(F.split(text, f"[^{PLAUSIBLE}]+"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    ranked = F.transform(parts, lambda p, i: F.struct(fragment_score(p).alias("s"), (-i).alias("i"), p.alias("p")))
    return F.array_max(ranked)["p"]


def ascii_preview(text: Column, least: int = 6, most: int = 96) -> Column:
    """The longest run of at least ``least`` printable ASCII characters, trimmed; of equal ones the first; cut with dots beyond ``most``."""
    runs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"[ -~]{{{least},}}"), F.lit(0)), lambda r: F.trim(r)), lambda r: F.length(r) > 0)
    best = F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    return F.when(F.length(best) > most, F.concat(F.substring(best, 1, most - 3), F.lit("..."))).otherwise(best)


def plain_mtext(text: Column) -> Column:
    r"""Formatted text without its markup.

    Escaped backslashes and braces are put aside first, so that each code is
    read where it starts: \P and \X break lines, \~ is a space, \L \O \K (and
    small ones) go, \U+XXXX is a character, \S...; is a stack with slashes, and
    format codes go up to their semicolon. Other codes leave their letter.
    """
    t = F.coalesce(text, F.lit(""))
    for code, aside in zip((r"\\\\", r"\\\{", r"\\\}"), ASIDE):
        t = F.regexp_replace(t, code, aside)
    t = F.regexp_replace(t, r"[{}]", "")
    codes = r"(\\S[^;]*;?|\\[Uu]\+[0-9a-fA-F]{4}|\\[ACcFfHhQqTtWwp][^;]*;?|\\.)"
    cut = F.split(F.regexp_replace(t, codes, f"{CUT}$1{CUT}"), CUT, -1)

    def read(p: Column) -> Column:
        return (
            F.when(p.rlike(r"^\\[PX]$"), F.lit("\n"))
            .when(p == "\\~", F.lit(" "))
            .when(p.rlike(r"^\\[LlOoKk]$"), F.lit(""))
            .when(p.rlike(r"^\\[Uu]\+[0-9a-fA-F]{4}$"), F.decode(F.unhex(F.substring(p, 4, 4)), "UTF-16BE"))
            .when(p.startswith("\\S"), F.regexp_replace(F.regexp_replace(F.substring(p, 3, 1 << 30), ";$", ""), "[#^]", "/"))
            .when(p.rlike(r"^\\[ACcFfHhQqTtWwp]"), F.lit(""))
            .when(p.rlike(r"^\\."), F.substring(p, 2, 1))
            .otherwise(p)
        )

    out = F.array_join(F.transform(cut, read), "")
    for aside, char in zip(ASIDE, "\\{}"):
        out = F.replace(out, F.lit(aside), F.lit(char))
    return out


def synthetic_handle(handle: Column, salt: int, index: Column) -> Column:
    """A handle for a recovered text; decimal, as source handles from 2**31 - 1 on don't fit 64 signed bits."""
    return (handle.cast("decimal(20,0)") + 1) * F.lit(1 << 32).cast("decimal(20,0)") + F.lit((salt & 0xFF) << 24) + index.bitwiseAND(0xFFFFFF)


def unknown_label(code: Column) -> Column:
    return F.concat(F.lit("UNKNOWN(0x"), F.hex(code), F.lit(")"))


def normal_fragment(text: Column) -> Column:
    """A fragment without space around it, and without the ASCII letter that ends a CJK one."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(t.rlike("[一-鿿]"), F.regexp_replace(t, r"(?U)\s*[A-Za-z]$", "")).otherwise(t)


def block_name(name: Column) -> Column:
    """A block's name without space around it; null for none."""
    return F.nullif(F.trim(name), F.lit(""))


def layout_block(name: Column) -> Column:
    """The name is that of a model or paper space block."""
    return F.coalesce(F.upper(name).startswith("*MODEL_SPACE") | F.upper(name).startswith("*PAPER_SPACE"), F.lit(False))


def layout_alias(name: Column, prefix: str = "LAYOUT_ALIAS_") -> Column:
    """A plain name for a layout's block: letters and digits in upper case, all else as ``_``."""
    plain = F.trim(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]", "_"), F.lit("_"))
    return F.concat(F.lit(prefix), F.when(plain == "", F.lit("LAYOUT")).otherwise(plain))


def six_digits(value: Column) -> Column:
    """A number with six significant digits and no trailing zeros; beyond 1e-4 to 1e6 with an exponent of at least two digits."""
    e = F.regexp_extract(F.format_string("%.5e", value), "e([+-][0-9]+)$", 1).cast("int")
    bare = lambda t: F.regexp_replace(t, r"(?:\.0+|(\.[0-9]*?)0+)$", "$1")
    fixed = F.coalesce(*[F.when(e == k, bare(F.format_string(f"%.{5 - k}f", value))) for k in range(-4, 6)])
    parts = F.split(F.format_string("%.5e", value), "e")
    return F.when(value == 0, F.lit("0")).when(e.between(-4, 5), fixed).otherwise(F.concat(bare(parts[0]), F.lit("e"), parts[1]))


def dimension_text(text: Column, measurement: Column) -> Column:
    """What a dimension shows: its measurement where the text is none, ``<>`` or a ``KEY=`` label, else the text."""
    own = text.isNull() | text.isin("", "<>") | F.contains(text, F.lit("="))
    return F.when(own & measurement.isNotNull(), six_digits(measurement)).otherwise(text)
