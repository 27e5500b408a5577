"""Column functions over contract text; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The clause header and the mark of a cut below are fixed values: stored records depend on them.
#: A section sign or one of three words, a dotted number, a title of 2 to 200 characters.
HEADER = r"(?iU)^\s*(?:§|Section|Article|Clause)?\s*(\d+(?:\.\d+)*)\.?\s+(.{2,200})$"
#: Where a text breaks into lines, as a Python str does.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
TRUNCATED = "\n\n[... TRUNCATED ...]\n\n"


def _folding() -> tuple[str, str]:
    """Accented Latin letters and, at the same place, their base letters, from the decomposition rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00))]
    # Greek letters lose their accents first, then both alphabets go by the lists below.
    pairs = [(a, b) for a, b in pairs if b != a and b.isascii()]
    greek = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0x386, 0x3CF)]
    pairs += [(a, _ALPHABETS.get(b, a)) for a, b in greek if len(_ALPHABETS.get(b, "xx")) == 1]
    pairs += [(a, b) for a, b in _ALPHABETS.items() if len(b) == 1 and a not in dict(pairs)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _alphabet(letters: str, plain: str) -> dict[str, str]:
    own = dict(zip(letters.split(), plain.split(), strict=True))
    return own | {a.upper(): b.upper() if len(b) == 1 else b.capitalize() for a, b in own.items()}


#: Greek and Cyrillic letters in Latin ones, and typographic marks in plain ones. Fixed values.
_ALPHABETS = (
    _alphabet("α β γ δ ε ζ η θ ι κ λ μ ν ξ ο π ρ σ τ υ φ χ ψ ω", "a b g d e z e th i k l m n x o p r s t u ph kh ps o")
    | _alphabet("а б в г д е ж з и й к л м н о п р с т у ф х ц ч ш щ ы э ю я ё і ї є", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch y e iu ia e i i ie")
    | {"ς": "s", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "€": "EUR", "£": "GBP"}
)


def ascii_folded(text: Column) -> Column:
    """Letters of the Latin, Greek and Cyrillic alphabets in ASCII; other scripts stay."""
    source, target = _folding()
    folded = F.translate(text, source, target)
    several = [(a, b) for a, b in _ALPHABETS.items() if len(b) > 1]
    for letter, plain in (*several, ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("þ", "th"), ("Þ", "Th")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    # Most texts are ASCII, which the two lengths tell.
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def normalize(text: Column) -> Column:
    """ASCII, lower case, single spaces, no space at the ends; null is the empty string."""
    return F.trim(F.regexp_replace(F.lower(ascii_folded(F.coalesce(text, F.lit("")))), r"\s+", " "))


def clause_key(number: Column) -> Column:
    """Letters, digits and dots of a clause number, lowered."""
    return F.regexp_replace(F.lower(F.coalesce(number, F.lit(""))), r"[^\p{L}\p{N}.]", "")


def content_hash(body: Column) -> Column:
    return F.sha2(F.trim(F.coalesce(body, F.lit(""))), 256)


def embedding_input(body: Column) -> Column:
    """What is embedded for a body: trimmed, a space if nothing is left."""
    return F.coalesce(F.nullif(F.trim(body), F.lit("")), F.lit(" "))


def structural_hash(clauses: Column) -> Column:
    """Hash of an ordered array of (number, title) structs' normalised headers."""
    return F.sha2(F.array_join(F.transform(clauses, lambda c: F.concat(normalize(c["number"]), F.lit("|"), normalize(c["title"]))), "\n"), 256)


def headers(text: Column) -> Column:
    """Array of (line, number, title) of the lines that look like clause headers, lines counted from 0."""
    return headers_in(F.split(text, LINE_BREAK))


def headers_in(lines: Column) -> Column:
    """The same of an array of lines."""
    found = F.transform(
        lines,
        lambda line, i: F.struct(
            i.alias("line"), F.regexp_extract(line, HEADER, 1).alias("number"), F.trim(F.regexp_extract(line, HEADER, 2)).alias("title")
        ),
    )
    return F.filter(found, lambda h: h["number"] != "")


def chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Sliding chunks of a text; the last one ends where the text ends."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def truncated(text: Column, tokens: int) -> Column:
    """Head and tail of a text of more than 4 characters a token, 60 to 40."""
    budget = 4 * tokens
    head = int(budget * 0.6)
    tail = max(budget - head - 32, 0)
    end = F.right(text, F.lit(tail)) if tail else F.lit("")
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(TRUNCATED), end))


def truncated_by(rows: DataFrame, column: str, tokens: int, encode, decode) -> DataFrame:
    """rows with long texts of a column cut by a tokenizer: 60 % of the budget from the head, what is left but 16 from the tail.

    encode: from a text to a list of tokens, decode: back. Texts reach it a batch at a time.
    """
    head = int(tokens * 0.6)
    tail = max(tokens - head - 16, 0)

    def cut(text):
        if text is None:
            return None
        found = encode(text)
        return text if len(found) <= tokens else decode(found[:head]) + TRUNCATED + (decode(found[-tail:]) if tail else "")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(column)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.set_column(at, part.schema.field(at), pa.array([cut(x) for x in part.column(at).to_pylist()], part.schema.field(at).type))

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two titles' normalised words; 0 if either has none."""
    x, y = (F.filter(F.split(normalize(t), " "), lambda w: w != "") for t in (a, b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / either)


def safe_id(doc_id: Column, number: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("::"), F.translate(number, " /", "__"))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Words that an English index leaves out. Fixed values.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Endings of plural and verb forms: (pattern with the stem as its first group, what takes the ending's place). The first that fits is applied.
ENDINGS = [
    (r"^(.+[^aeiou])ies$", "y"), (r"^(.+(?:ss|sh|ch|x|z))es$", ""), (r"^(.+[^su])s$", ""),
    (r"^(.*[aeiouy].*[^aeiou])ied$", "y"), (r"^(.*[aeiouy].*(?:at|bl|iz))(?:ed|ing)$", "e"), (r"^(.*[aeiouy].*(?:ll|ss|zz))(?:ed|ing)$", ""),
    *((rf"^(.*[aeiouy].*{c}){c}(?:ed|ing)$", "") for c in "bdgmnprt"), (r"^(.*[aeiouy].+)(?:ed|ing)$", ""),
]


def stemmed(term: Column) -> Column:
    """An English term without a plural or verb ending."""
    out = term
    for pattern, put in reversed(ENDINGS):
        out = F.when(F.regexp_like(term, F.lit(pattern)), F.regexp_replace(term, pattern, f"$1{put}")).otherwise(out)
    return out


def analyzed(text: Column) -> Column:
    """English terms: possessives cut, stop words left out, endings of plurals and verbs taken off."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"['\u2019]s\b", "")
    return F.transform(F.filter(terms(plain), lambda w: ~w.isin(STOP_WORDS)), stemmed)


def processed_key(tenant_id: Column, doc_id: Column, file: str) -> Column:
    """Where an artefact of a document lies."""
    return F.concat_ws("/", tenant_id, doc_id.cast("string"), F.lit(file))


def ids_from_key(key: Column, doc_id: Column, tenant_id: Column) -> Column:
    """(tenant_id, doc_id) of an upload key ``tenants/<t>/uploads/<d>/...``, else the given ones, key and "default"."""
    part = F.split(key, "/")
    known = (F.size(part) >= 4) & (F.try_element_at(part, F.lit(1)) == "tenants") & (F.try_element_at(part, F.lit(3)) == "uploads")
    return F.struct(
        F.when(known, F.try_element_at(part, F.lit(2))).otherwise(F.coalesce(F.nullif(tenant_id, F.lit("")), F.lit("default"))).alias("tenant_id"),
        F.when(known, F.try_element_at(part, F.lit(4))).otherwise(F.coalesce(F.nullif(doc_id, F.lit("")), key)).alias("doc_id"),
    )


def media_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.endswith(".pdf"), "application/pdf")
        .when(low.endswith(".docx"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when(low.endswith(".doc"), "application/msword")
        .when(low.endswith(".txt"), "text/plain")
        .otherwise("application/octet-stream")
    )


def file_type(path: Column, content: Column) -> Column:
    """pdf or docx by name or leading bytes; null for anything else."""
    low, head = F.lower(path), F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.when(low.endswith(".pdf") | (F.instr(head, "%PDF") > 0), "pdf").when(low.endswith(".docx") | head.startswith("PK\x03\x04"), "docx")


def delta_percent(before: Column, after: Column) -> Column:
    a, b = F.length(before), F.length(after)
    return F.abs(b - a) / F.greatest(a, b, F.lit(1)) * 100.0


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, null if either has no length."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def utc_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
