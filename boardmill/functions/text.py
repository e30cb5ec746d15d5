"""Column functions over captions, names and cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the plain letters that compatibility decomposition leaves.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĢģĪīĮįİĶķĹĺĻļĽľŃńŅņŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŹźŻżŽžȘșȚț"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgGgIiIiIKkLlLlLlNnNnNnOoOoRrRrSsSsSsTtTtUuUuUuUuZzZzZzSsTt"
_DASHES = "‐‑‒–—―−"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text: Column | str) -> Column:
    """Text for comparison: ß as ss, Latin marks removed, every dash as '-', spaces collapsed, lower case."""
    even = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    def folded(c: Column) -> Column:
        bare = F.translate(F.regexp_replace(F.regexp_replace(c, "ß", "ss"), r"\p{Mn}+", ""), _MARKED, _PLAIN)
        # there is nothing to replace in a text of ASCII
        return F.when(F.octet_length(c) == F.char_length(c), even(c)).otherwise(even(F.regexp_replace(bare, f"[{_DASHES}]", "-")))

    return let(_col(text), folded)


def surname(name: Column | str) -> Column:
    """The folded part before the first comma, without leading initials unless they are all there is."""
    family = F.trim(F.split_part(fold(name), F.lit(","), F.lit(1)))
    return F.regexp_replace(family, r"^((\S+\.|\S)\s+)+(?=\S)", "")


def unordered_pair(a: Column | str, b: Column | str) -> Column:
    """The two values in order, so that pairs compare without regard to it."""
    return F.array(F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b)))


def clean_cell(value: Column | str) -> Column:
    """A cell's text: null and 'nan' are empty, spaces at the ends go."""
    c = F.trim(F.coalesce(_col(value).cast("string"), F.lit("")))
    return F.when(F.lower(c) == "nan", "").otherwise(c)


def integer_text(value: Column | str) -> Column:
    """'20.0' as '20'; what is no whole number stays as it is."""
    c = clean_cell(value)
    n = c.try_cast("double")
    return F.when(n.isNotNull() & (n == F.floor(n)) & (F.abs(n) < 9e15), n.cast("bigint").cast("string")).otherwise(c)


def positive_int(value: Column | str) -> Column:
    """Integer text of 1 or more as a number, else null ('3.0' is null)."""
    c = F.trim(_col(value).cast("string"))
    n = F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int"))
    return F.when(n >= 1, n)


def truthy(value: Column | str) -> Column:
    """Whether a cell says yes: 1, true, sim, yes or x, in any case."""
    return F.lower(F.trim(F.coalesce(_col(value), F.lit("")))).isin("1", "true", "sim", "yes", "x")


def allowed_only(text: Column | str, allowed: str) -> Column:
    """Text without the characters that aren't in ``allowed``; null if nothing is left."""
    escaped = "".join("\\" + c if c in "\\]^-[&" else c for c in allowed)
    return F.nullif(F.regexp_replace(_col(text), f"[^{escaped}]", ""), F.lit(""))


def flat_caption(lines: Column | str, limit: int = 300) -> Column:
    """The non-empty lines joined by ' / ', double quotes as single ones, cut at ``limit`` with an ellipsis."""
    kept = F.filter(F.transform(_col(lines), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    text = F.translate(F.array_join(kept, " / "), '"', "'")
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


# Forms, folded, that say who moves, and the names of the sides in them.  Portuguese, English, German, Spanish, French.
SIDE_FORMS = [
    (["(as )?{s} (jogam|jogar|comecam|iniciam)", "jog(ada|ar|am|a) (das|dos|da|do|de|as|os) {s}", "(e a )?vez d[ao]s {s}", "{s} no lance"], "brancas", "(pretas|negras)"),
    (["{s} to (move|play)", "{s} (plays|moves|begins|starts)"], "white", "black"),
    (["{s} (am zug|zieht|beginnt|spielt|setzt)", "am zug ?: ?{s}"], "weiss?", "schwarz"),
    (["juegan (las )?{s}", "{s} juegan", "turno de las {s}"], "blancas", "negras"),
    (["(les )?{s} jouent", "trait aux {s}"], "blancs", "noirs"),
]
# what a language's phrases of a side all contain, and the phrases
WHITE_PHRASES = [([white.removesuffix("s?")], [form.format(s=white) for form in forms]) for forms, white, _ in SIDE_FORMS]
BLACK_PHRASES = [(black.strip("()").split("|"), [form.format(s=black) for form in forms]) for forms, _, black in SIDE_FORMS]
# Words, folded, that make a supposition of the phrase after them.
SUBORDINATORS = ["se", "if", "when", "wenn", "quando", "after", "depois", "apos", "because", "porque", "since", "although", "though", "embora", "caso", "que", "para", "wo", "als", "nachdem", "wie"]
# Hollow squares and discs, filled ones.
WHITE_GLYPHS, BLACK_GLYPHS = "◻□▫⬜◽⚪", "◼■▪⬛◾⚫"


def let(value: Column, body) -> Column:
    """``body`` of a value that is spelled, and computed, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_phrase(folded: Column, phrases: list[tuple[list[str], list[str]]]) -> Column:
    """(place, evidence) of the earliest phrase that no subordinator stands before, null if there is none.

    A language's phrases are only looked for where the side's name is.
    """

    def found(phrase: str) -> Column:
        pattern = f"\\b({phrase})\\b"

        def judged(at: Column) -> Column:
            before = F.element_at(F.split(F.rtrim(F.substring(folded, F.lit(1), at - 1)), " "), -1)
            return F.when((at > 0) & ~before.isin(SUBORDINATORS), F.struct(at.cast("int").alias("place"), F.regexp_extract(folded, pattern, 1).alias("evidence")))

        return let(F.regexp_instr(folded, F.lit(pattern)), judged)

    named = lambda names: reduce(Column.__or__, [F.contains(folded, F.lit(n)) for n in names])
    least = lambda some: F.array_min(F.array_compact(F.array(*some)))
    return least(F.when(named(names), least(map(found, some))) for names, some in phrases)


def side_phrase(text: Column | str) -> Column:
    """struct(side, evidence): who moves by the earliest phrase; null if none, or if both sides are named."""
    both = lambda folded: F.struct(_first_phrase(folded, WHITE_PHRASES).alias("w"), _first_phrase(folded, BLACK_PHRASES).alias("b"))
    said = lambda p: F.when(p["w"].isNotNull() & p["b"].isNull(), F.struct(F.lit("w").alias("side"), p["w"]["evidence"].alias("evidence"))).when(p["b"].isNotNull() & p["w"].isNull(), F.struct(F.lit("b").alias("side"), p["b"]["evidence"].alias("evidence")))
    return let(let(fold(text), both), said)


def side_symbol(text: Column | str) -> Column:
    """struct(side, evidence) of the first hollow or filled square, or null."""
    glyph = F.regexp_extract(_col(text), f"[{WHITE_GLYPHS}{BLACK_GLYPHS}]", 0)
    return F.when(glyph != "", F.struct(F.when(F.position(glyph, F.lit(WHITE_GLYPHS)) > 0, "w").otherwise("b").alias("side"), glyph.alias("evidence")))


def side_of_line(text: Column | str, caption_like: Column) -> Column:
    """Who moves by a line: by a symbol, else a phrase, anywhere in a caption; in a paragraph only by a phrase that opens the line."""
    phrase = let(side_phrase(text), lambda p: F.when(caption_like | F.startswith(fold(text), p["evidence"]), p))
    return F.coalesce(F.when(caption_like, side_symbol(text)), phrase)


def exercise_number(text: Column | str) -> Column:
    """The number of a bare number line, or of a prefix such as '12. ', 'nº 12.', 'No. 7', 'Diagram 3'."""
    c = F.trim(_col(text))
    bare = F.regexp_extract(c, r"^\(?#?(\d{1,4})[.)]?$", 1)
    prefix = F.regexp_extract(c, r"(?i)^(?:n[º°o]\.?|no\.?|nr\.?|diagram[am]?e?|exerc[ií]cio|problem[a]?|fig\.?)\s*(\d{1,4})\b", 1)
    opening = F.regexp_extract(c, r"^\(?#?(\d{1,4})[.)]\s+\D", 1)
    loose = F.when(F.length(c) <= 7, F.regexp_extract(F.translate(c, "OolI", "0011"), r"^(\d{1,4})[.)]$", 1))
    return F.coalesce(*[F.nullif(x, F.lit("")).try_cast("int") for x in (bare, prefix, opening, loose)])


def without_number(text: Column | str) -> Column:
    """Text without its leading exercise number."""
    return F.trim(F.regexp_replace(F.trim(_col(text)), r"(?i)^(?:(?:n[º°o]\.?|no\.?|nr\.?|diagram[am]?e?|exerc[ií]cio|problem[a]?|fig\.?)\s*)?\(?#?\d{1,4}[.)]\s+", ""))


def players(text: Column | str) -> Column:
    """struct(white, black) of 'A - B' at a line's end: capitalised names, no move, no year, no side phrase; or null."""
    pattern = r"(\p{Lu}[\p{L}.'’ ,]*?)\s+[-–—]\s+(\p{Lu}[\p{L}.'’ ]*?)(?:\s*[,(].*)?$"
    move = r"^[KQRBNTDCA]?[a-h]?[1-8]?x?[a-h][1-8]"

    def judged(p: Column) -> Column:
        w, b = p["white"], p["black"]
        good = (w != "") & (b != "") & ~w.rlike(move) & ~b.rlike(move) & ~w.rlike(r"\d{4}")
        return F.when(good, F.when(side_phrase(text).isNull(), p))

    named = let(without_number(text), lambda c: F.struct(F.trim(F.regexp_extract(c, pattern, 1)).alias("white"), F.trim(F.regexp_extract(c, pattern, 2)).alias("black")))
    # most lines have no dash between spaces
    return F.when(_col(text).rlike(r"\s[-–—]\s"), let(named, judged))


def event_year(text: Column | str) -> Column:
    """struct(event, year): a year from 1500 to 2099 and the text before it, else after it."""
    century = r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)"

    def said(c: Column) -> Column:
        before = F.trim(F.regexp_replace(F.regexp_extract(c, r"^(.*?)(?<!\d)(?:1[5-9]\d\d|20\d\d)(?!\d)", 1), r"[\s,;(–-]+$", ""))
        after = F.trim(F.regexp_replace(F.regexp_extract(c, r"(?<!\d)(?:1[5-9]\d\d|20\d\d)(?!\d)(.*)$", 1), r"^[\s,;)–-]+", ""))
        year = F.regexp_extract(c, century, 1).cast("int").alias("year")
        return F.when(c.rlike(century), F.struct(F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).alias("event"), year))

    return let(F.trim(_col(text)), said)


def caption_context(caption: Column | str, page_number: Column | None = None) -> Column:
    """struct(side, evidence, exercise, white, black, event, year) of a caption; the exercise is never the page's number."""
    c = _col(caption)
    lines = F.split(c, "\n")
    side = F.coalesce(side_phrase(c), side_symbol(c))
    exercise = F.get(F.filter(F.transform(lines, exercise_number), lambda n: n.isNotNull() & (F.lit(True) if page_number is None else ~n.eqNullSafe(page_number))), F.lit(0))
    pair = F.get(F.filter(F.transform(lines, players), lambda p: p.isNotNull()), F.lit(0))
    dated = F.get(F.filter(F.transform(lines, event_year), lambda e: e.isNotNull()), F.lit(0))
    # each part is bound once, or every field of the result would search the caption again
    parts = F.struct(side.alias("side"), exercise.alias("exercise"), pair.alias("pair"), dated.alias("dated"))
    fields = {"side": "side", "evidence": "side", "white": "pair", "black": "pair", "event": "dated", "year": "dated"}
    order = ["side", "evidence", "exercise", "white", "black", "event", "year"]
    return let(parts, lambda p: F.struct(*[(p[fields[n]][n] if n in fields else p[n]).alias(n) for n in order]))


def caption_pair(caption: Column | str) -> Column:
    """The folded surnames of a caption's players as an unordered pair, or null."""
    def pair(p: Column) -> Column:
        w, b = surname(p["white"]), surname(p["black"])
        return F.when(p.isNotNull() & (w != "") & (b != ""), unordered_pair(w, b))

    return let(players(caption), pair)


def thousands(value: Column | str) -> Column:
    """A whole number with '.' between thousands."""
    return F.translate(F.format_number(_col(value), 0), ",", ".")


def percent(fraction: Column | str, places: int = 1) -> Column:
    """A fraction as '8,2%'."""
    return F.concat(F.translate(F.format_string(f"%.{places}f", _col(fraction) * 100.0), ".", ","), F.lit("%"))


def human_size(size: Column | str) -> Column:
    """Bytes as '1,2 GB' or '34 MB'."""
    c = _col(size)
    gb = F.translate(F.format_string("%.1f GB", c / F.lit(1e9)), ".", ",")
    return F.when(c >= 1_000_000_000, gb).otherwise(F.format_string("%.0f MB", c / F.lit(1e6)))


def ordered_digest(lines: Column, length: int = 16) -> Column:
    """An aggregate: sha256 of the sorted lines joined by newlines, its first hex digits."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256), 1, length)
