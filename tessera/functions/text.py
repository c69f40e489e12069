"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, and the Unicode properties of the character classes.
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
UPPER, LOWER_, SPACE = r"\p{IsUppercase}", r"\p{IsLowercase}", r"\p{IsWhite_Space}"
# Marks of code.  A strong one is enough; a weak one counts beside braces, semicolons or a second line.
STRONG_CODE = ("fn ", "def ", "println", "print(", "#!/", "pub fn ", "async fn ", "```")
WEAK_CODE = (
    "fn ", "def ", "let ", "pub ", "import ", "return ", "print(", "println", "class ", "const ", "var ", "function", "#!/", "->", "::", "self.", "this.",
    "async ", "await ", "struct ", "impl ", "use ", "from ", "```", "#[", "include ", "package ", "module ", "export ", "require(", "console.", "std::",
    "Result<", "Option<", "Vec<", "match ", "else {", "if (", "for (", "while (", "elif ", "endif", "done", "echo ", "cargo ", "npm ",
)
CODE_MARKS = r"[{}();=<>]"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """One pass with an alternation of literals."""
    import re

    return text.rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words))


def char_classes(text: Column) -> Column:
    """Counts of upper case, lower case, white space, ASCII punctuation and other characters, in that priority."""
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    known = [n(UPPER), n(LOWER_), n(SPACE), n(ASCII_PUNCTUATION)]
    names = ("upper", "lower", "space", "punct")
    return F.struct(*[c.alias(k) for k, c in zip(names, known)], (F.length(text).cast("long") - sum(known[1:], known[0])).alias("other"))


def byte_entropy(text: Column) -> Column:
    """Shannon entropy of the bytes over 8 bits; 0 for an empty text.  Sorted bytes make runs, whose ends give the counts: linear but for the sort."""
    codes = F.array_sort(F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "), " "), lambda x: x != ""))
    size = F.size(codes).cast("double")
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    add = lambda acc: acc["sum"] + F.when(acc["run"] > 0, acc["run"] * F.log2(acc["run"].cast("double"))).otherwise(0.0)
    step = lambda acc, x: F.when(acc["last"] == x, F.struct(acc["last"].alias("last"), (acc["run"] + 1).alias("run"), acc["sum"].alias("sum"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("run"), add(acc).alias("sum")))
    total = F.aggregate(codes, start, step, add)
    return F.when(F.length(text) == 0, 0.0).otherwise((F.log2(F.greatest(size, F.lit(1.0))) - total / F.greatest(size, F.lit(1.0))) / 8)


def squash(text: Column) -> Column:
    """Without control characters but line feed and tab; runs of white space as one blank, runs of one letter as two."""
    no_control = F.regexp_replace(text, r"[\p{Cc}&&[^\t\n]]", "")
    one_blank = F.regexp_replace(no_control, f"{SPACE}+", " ")
    return F.regexp_replace(one_blank, r"(\p{IsAlphabetic})\1{2,}", "$1$1")


def reduction(text: Column) -> Column:
    """1 - characters after squash / characters before; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0.0).otherwise(1 - F.length(squash(text)) / F.length(text))


def looks_like_code(text: Column) -> Column:
    n = lambda p: F.regexp_count(text, F.lit(p))
    braces, semicolons, several = n(r"[{}]"), n(";"), F.contains(text, F.lit("\n"))
    calls = F.contains(text, F.lit("(")) & F.contains(text, F.lit(")")) & several & (semicolons >= 1)
    beside = (braces >= 1) | (semicolons >= 1) | several
    return has_any(text, STRONG_CODE) | (has_any(text, WEAK_CODE) & beside) | (braces >= 2) | (semicolons >= 2) | ((n("=") >= 2) & several) | calls


def indented_code(text: Column) -> Column:
    """Two or more lines that begin with a blank or tab."""
    return F.regexp_count(text, F.lit(r"(?m)^[ \t]")) >= 2


def code_line_shape(text: Column) -> Column:
    """Two lines or more that are not blank, half of them under 72 bytes, three or more code marks."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"{SPACE}+", "") != "")
    short = F.size(F.filter(lines, lambda x: F.octet_length(F.rtrim(F.lit("\r"), x)) < 72))
    return (F.size(lines) >= 2) & (2 * short >= F.size(lines)) & (F.regexp_count(text, F.lit(CODE_MARKS)) >= 3)


def heading_level(line: Column) -> Column:
    """Number of # before a blank; 0 for other lines."""
    return F.length(F.regexp_extract(line, r"^(#+) ", 1))


def numbered_item(line: Column) -> Column:
    """Text after ``1. ``; null for other lines."""
    found = F.regexp_extract(line, r"^\d+\. (.*)$", 1)
    return F.when(line.rlike(r"^\d+\. "), found)


def path_kind(path: Column) -> Column:
    """Execution for source files, else Content."""
    return F.when(F.regexp_extract(path, r"\.([^./]+)$", 1).isin("rs", "py", "sh", "js", "ts"), "Execution").otherwise("Content")


def glyph_class(c: Column) -> Column:
    """Class of one character by its code point."""
    return (
        F.when(c.rlike(f"^{SPACE}$"), "space")
        .when(c.rlike(r"^[0-9]$"), "digit")
        .when(c.rlike(f"^{ASCII_PUNCTUATION}$"), "punct")
        .when(c.rlike(r"^[A-Za-z]$"), "letter")
        .when(c.rlike("^[\u0300-\u036f]$"), "combining")
        .when(c.rlike("^[\u4e00-\u9fff\u3040-\u30ff]$"), "wide")
        .when(c.rlike(r"^\p{ASCII}$"), "narrow")
        .when(c.rlike(r"^\p{IsAlphabetic}$"), "letter")
        .when(~c.rlike(r"^\p{Cc}$"), "symbol")
        .otherwise("other")
    )


def glyph_fingerprint(text: Column) -> Column:
    """Hash of the class stream, number of distinct classes, length.  The hash is this engine's own."""
    classes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), glyph_class)
    return F.struct(F.xxhash64(F.array_join(classes, ",")).alias("hash"), F.size(F.array_distinct(classes)).alias("diversity"), F.size(classes).alias("length"))


def extract_text(payload: Column) -> Column:
    """First of text, prompt and content in a JSON object; else empty."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("text", "prompt", "content")], F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a as 16 hex digits, in decimals, so that no bit is lost."""
    raw = F.hex(F.encode(text, "UTF-8"))
    wrap = F.lit("18446744073709551616").cast("decimal(38,0)")

    # offset 14695981039346656037, prime 1099511628211 = 2^40 + 435; the xor touches the low byte only.
    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(raw, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        low = (h % 256).cast("int")
        mixed = h - low.cast("decimal(38,0)") + low.bitwiseXOR(byte).cast("decimal(38,0)")
        return ((mixed * 435 + (mixed % 16777216) * F.lit("1099511627776").cast("decimal(13,0)")).cast("decimal(38,0)") % wrap).cast("decimal(38,0)")

    start = F.lit("14695981039346656037").cast("decimal(38,0)")
    index = F.when(F.length(raw) > 0, F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(index, start, step)
