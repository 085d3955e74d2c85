"""Text functions: chunking, HTML to text, message lines and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _once(value: Column, use) -> Column:
    """Bind ``value`` to a name, so that an expression used many times is evaluated once per row."""
    return F.transform(F.array(value), use)[0]


def fixed_chunks(text: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters that start ``size - overlap`` apart; the last covers the end.

    One pass cuts the text into steps; a chunk is a step and the head of the next one. Substring by
    position would walk the text from its start again for every chunk.
    """
    step = size - overlap
    steps = F.regexp_extract_all(_col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def chunks(steps: Column) -> Column:
        # A last step no longer than the overlap lies wholly inside the chunk before it.
        covered = (F.size(steps) > 1) & (F.length(F.element_at(steps, -1)) <= overlap)
        whole = F.slice(steps, 1, F.size(steps) - covered.cast("int"))

        def with_head(step: Column, i: Column) -> Column:
            head = F.left(F.get(steps, i + 1), F.lit(overlap))
            return F.concat(step, F.coalesce(head, F.lit("")))

        return F.transform(whole, with_head)

    return _once(steps, chunks)


def separator_pattern(step: int, separators=SEPARATORS) -> str:
    """Match up to ``step`` characters, ending at the coarsest separator that fits."""
    ends = [f".{{0,{step - len(s)}}}\\Q{s}\\E" for s in separators]
    return "(?s)" + "|".join([f".{{1,{step}}}\\z", *ends, f".{{1,{step}}}"])


def separator_chunks(
    text: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS
) -> Column:
    """Chunks of at most ``size`` characters cut at the coarsest separator that fits.

    The text is cut into segments that together are the text, each no longer than ``size - overlap``.
    A chunk is a segment after the end of the one before it: at most ``overlap`` characters, from
    the first whole word on.
    """
    segments = F.regexp_extract_all(_col(text), F.lit(separator_pattern(size - overlap, separators)), F.lit(0))
    return _once(
        segments,
        lambda g: F.transform(
            g, lambda s, i: F.concat(F.when(i > 0, _tail(F.get(g, i - 1), overlap)).otherwise(""), s)
        ),
    )


def _tail(segment: Column, overlap: int) -> Column:
    tail = F.right(segment, F.lit(overlap))
    whole_words = F.regexp_replace(tail, r"^[^ \n]*[ \n]+", "")
    return F.when(F.length(segment) <= overlap, segment).otherwise(whole_words)


def html_text(html: Column | str) -> Column:
    """Readable text of a page: scripts, styles, comments and tags removed, blanks collapsed."""
    text = F.regexp_replace(_col(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def outage_line(start: Column | str, end: Column | str, reason: Column | str) -> Column:
    """One line of a reply about a planned outage."""

    def minute(moment: Column) -> Column:
        return F.substring(moment.cast("string"), 1, 16)

    return F.concat(
        minute(_col(start)),
        F.lit(" to "),
        F.coalesce(minute(_col(end)), F.lit("further notice")),
        F.lit(": "),
        F.coalesce(_col(reason), F.lit("no reason given")),
    )


def fill_template(template: str, **values: Column | str) -> Column:
    """Put columns into the ``{name}`` places of a template; inserted text is not searched again."""
    pieces: list[Column] = []
    rest = template
    while rest:
        places = [(rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest]
        if not places:
            pieces.append(F.lit(rest))
            break
        at, name = min(places)
        pieces += [F.lit(rest[:at]), F.coalesce(_col(values[name]), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, for use inside one row."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
