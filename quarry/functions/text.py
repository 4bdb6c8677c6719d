"""Labels, tokens, identifiers and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, marks and numbers of any script, and the underscore.
UNICODE_WORD = r"(?U)(\w+)"
#: What search counts as a word: letters, marks and numbers; the underscore parts words.
SEARCH_WORD = r"[\p{L}\p{M}\p{N}]+"
#: What marks a query of several parts.
COMPOUND_MARKS = (" and ", " or ", " vs ", " und ", " oder ", " sowie ", ", ", "; ", "? ")
PREFIXES = {"youtube": "yt", "instagram": "ig", "tiktok": "tt"}
#: Characters that a file name may not have.
UNSAFE = '/\\:*?"<>|'


def match_tokens(query: Column) -> Column:
    """Words of a query, as they come."""
    return F.regexp_extract_all(query, F.lit(UNICODE_WORD), F.lit(1))


def match_query(query: Column) -> Column:
    """Each word in double quotes, joined by OR; empty without words."""
    return F.array_join(F.transform(match_tokens(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def search_words(text: Column) -> Column:
    """Words of a text by SEARCH_WORD, in lower case, as they come: what the runs of other characters leave."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def bracket_label(ms: Column) -> Column:
    """[m:ss] of milliseconds, minutes unbounded; null stays null."""
    s = F.floor(ms / 1000)
    return F.when(ms.isNotNull(), F.format_string("[%d:%02d]", F.floor(s / 60), s % 60))


def clock_label(ms: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(ms.isNull(), F.lit(None)).when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def precise_label(seconds: Column) -> Column:
    """m:ss.mmm, or h:mm:ss.mmm; what is negative or no finite number counts as 0."""
    fine = ~F.isnan(seconds) & (seconds >= 0) & (seconds < F.lit(float("inf")))
    ms = F.when(fine, F.round(seconds * 1000)).otherwise(F.lit(0)).cast("long")
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(seconds.isNull(), F.lit(None)).when(h > 0, F.format_string("%d:%02d:%02d.%03d", h, m, s % 60, ms % 1000)).otherwise(F.format_string("%d:%02d.%03d", m, s % 60, ms % 1000))


def label_to_ms(label: Column, *, strict: bool = False) -> Column:
    """Milliseconds of s, m:ss or h:mm:ss; null for anything else.

    With strict every part is a whole number; else the last may have decimals
    after a point or comma, as the short-form writers emit.
    """
    parts = F.split(F.trim(label), ":")
    last = r"[0-9]+" if strict else r"[0-9]+([.,][0-9]+)?"
    shape = rf"^([0-9]+:){{0,2}}{last}$"
    seconds = F.aggregate(F.transform(parts, lambda p: F.translate(p, ",", ".").try_cast("double")), F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.when(F.trim(label).rlike(shape), F.round(seconds * 1000).cast("long"))


def cue_seconds(label: Column) -> Column:
    """Seconds of a cue time; decimals after a point or a comma."""
    return label_to_ms(label) / F.lit(1000.0)


def iso_to_ms(text: Column, default: Column | None = None) -> Column:
    """Milliseconds since the epoch of an ISO time, UTC where it names no zone; default (else null) where it is none."""
    found = F.unix_millis(F.try_to_timestamp(text))
    return found if default is None else F.coalesce(found, default)


def approx_tokens(text: Column) -> Column:
    """Characters over 3.5, rounded up and 1 at least; 0 for blank text."""
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 3.5))).cast("long")


def normalized(text: Column) -> Column:
    """Lower case, runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and numbers, of two characters at least."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: F.length(t) >= 2)


def keyword_weight(haystack: Column, tokens: Column) -> Column:
    """2 for each token that starts the haystack or follows a space, 1 for one elsewhere; 0 unless all occur."""
    weight = F.aggregate(tokens, F.lit(0), lambda acc, t: acc + F.when(F.startswith(haystack, t) | F.contains(haystack, F.concat(F.lit(" "), t)), 2).otherwise(1))
    return F.when(F.forall(tokens, lambda t: F.contains(haystack, t)), weight).otherwise(F.lit(0))


def tag_list(text: Column) -> Column:
    """Tags of [a, "b"] or a, b: brackets and quotes go, empty ones too; commas inside double quotes do not part."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    parts = F.regexp_extract_all(inner, F.lit(r'\s*("(?:[^"\\]|\\.)*"|[^,]+)'), F.lit(1))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), r"""^["']|["']$""", ""))), lambda p: p != "")


def json_strings(text: Column) -> Column:
    """A JSON array of strings; anything else gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def qualified_id(platform: Column, raw: Column) -> Column:
    """yt:, ig: or tt: and the raw id; other platforms by their name."""
    prefix = platform
    for name, short in PREFIXES.items():
        prefix = F.when(platform == name, F.lit(short)).otherwise(prefix)
    return F.concat(prefix, F.lit(":"), raw)


def default_url(platform: Column, raw: Column) -> Column:
    """A video's address where its note names none."""
    return (
        F.when(platform == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), raw))
        .when(platform == "instagram", F.concat(F.lit("https://www.instagram.com/reel/"), raw, F.lit("/")))
        .when(platform == "tiktok", F.concat(F.lit("https://www.tiktok.com/@/video/"), raw))
        .otherwise(F.lit(""))
    )


def platform_of(url: Column) -> Column:
    """youtube, tiktok or instagram by what an address contains, tried in this order; else null."""
    low = F.lower(url)
    return (
        F.when(F.contains(low, F.lit("youtube.com")) | F.contains(low, F.lit("youtu.be")), F.lit("youtube"))
        .when(F.contains(low, F.lit("tiktok.com")), F.lit("tiktok"))
        .when(F.contains(low, F.lit("instagram.com")), F.lit("instagram"))
    )


def youtube_id(url: Column) -> Column:
    """The eleven characters after youtu.be/, shorts/, embed/, live/ or v=; else null."""
    found = F.regexp_extract(url, r"(?:youtu\.be/|/shorts/|/embed/|/live/|[?&]v=)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.nullif(found, F.lit(""))


def tiktok_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(?:video|v)/([0-9]{6,25})", 1), F.lit(""))


def instagram_code(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(?:reel|reels|p|tv)/([A-Za-z0-9_-]+)", 1), F.lit(""))


def html_unescaped(text: Column) -> Column:
    """The seven entities that transcripts have; &amp; first, so that what it hides is decoded too."""
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def hashtags(text: Column, body: str = r"\p{L}\p{N}") -> Column:
    """Distinct lower-case tags after #, sorted; body is the character class of a tag."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"#([{body}]+)"), F.lit(1)), F.lower)))


#: The class of captions that name a Latin range and the underscore.
CAPTION_TAG = r"A-Za-z0-9_À-ɏḀ-ỿ"


def tag_union(a: Column, b: Column) -> Column:
    """Distinct lower-case tags of two lists, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), F.lower)))


def safe_name(text: Column, limit: int = 80) -> Column:
    """A file name: unsafe characters go, blanks collapse, limit characters at most; dots alone give an empty name."""
    name = F.left(F.trim(F.regexp_replace(F.translate(text, UNSAFE, ""), r"\s+", " ")), F.lit(limit))
    return F.when(name.rlike(r"^\.+$"), F.lit("")).otherwise(name)


def folder_name(channel: Column, title: Column, raw: Column) -> Column:
    """Channel - Title, or what there is of them, else the id."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.nullif(safe_name(F.concat_ws(" - ", blank(channel), blank(title))), F.lit("")), raw)


def yaml_quoted(text: Column) -> Column:
    """In double quotes, with backslash and quote escaped and line ends as spaces."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def yaml_unquoted(text: Column) -> Column:
    """The inverse of yaml_quoted; bare text stays."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    plain = F.replace(F.replace(F.replace(inner, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit('"')), F.lit("\u0001"), F.lit("\\"))
    return F.when(text.rlike(r'^".*"$') & (F.length(text) >= 2), plain).otherwise(text)


def looks_compound(query: Column) -> Column:
    """Whether a query has four words or one of COMPOUND_MARKS, with a blank before and after it."""
    padded = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    marked = F.exists(F.array(*map(F.lit, COMPOUND_MARKS)), lambda m: F.contains(padded, m))
    return (F.size(F.split(F.trim(query), r"\s+")) >= 4) | marked


def clamped(text: Column, limit: int = 10_000) -> Column:
    return F.left(text, F.lit(limit))


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\n---[ \t]*(?:\r?\n|\z)", "")


def relative_path(path: Column, root: Column) -> Column:
    """path below root; a path elsewhere stays."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def first_height(label: Column) -> Column:
    """The first run of digits of a label such as 1080p60."""
    return F.regexp_extract(label, "([0-9]+)", 1).try_cast("int")


def escapes_folder(path: Column) -> Column:
    """Whether a stored path leaves its folder."""
    return F.contains(path, F.lit("..")) | F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\x00"))


def is_https(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)) == "https", F.lit(False))


def caption_title(caption: Column, fallback: Column, limit: int = 80) -> Column:
    """A title from a caption: its first line without tags and mentions at either end, to its first sentence, cut at a word."""
    line = F.trim(F.split(F.trim(caption), r"\r?\n")[0])
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"^(?:[#@]\S+\s*)+", ""), r"(?:\s*[#@]\S+)+$", ""))
    sentence = F.trim(F.regexp_extract(bare, r"^(.*?[.!?])(?:\s|$)", 1))
    pick = F.coalesce(F.nullif(sentence, F.lit("")), F.nullif(bare, F.lit("")), fallback)
    head = F.left(pick, F.lit(limit))
    at_word = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(pick) <= limit, pick).when(F.length(at_word) * 2 >= limit, at_word).otherwise(head)


def is_supported_link(url: Column) -> Column:
    """Whether an address is of a known platform."""
    return platform_of(url).isNotNull()


def truncated_ids(ids: Column, limit: int = 256) -> Column:
    """At most limit ids, the last of all among them: an encoder's end mark stays."""
    return F.when(F.size(ids) <= limit, ids).otherwise(F.concat(F.slice(ids, 1, limit - 1), F.slice(ids, -1, 1)))


def wrapped(text: Column, width: int = 80) -> Column:
    """The text's words in lines of at most width characters, as an array; a longer word has a line of its own."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.regexp_replace(one, rf"(?s)([^ ]{{{width + 1},}}|.{{1,{width}}})(?: |$)", "$1\n")
    return F.when(one == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(cut, r"\n$", ""), "\n"))


def markdown_page(title: Column, texts: Column, width: int = 80) -> Column:
    """A page of a title and texts, an array, wrapped."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(wrapped(F.array_join(texts, " "), width), "\n"), F.lit("\n"))


def longest_ms(claimed: Column, measured: Column) -> Column:
    """The larger of a claimed and a measured duration; what was measured counts only if it is finite and above nothing."""
    real = F.when((measured > 0) & ~F.isnan(measured.cast("double")) & (measured.cast("double") < F.lit(float("inf"))), measured)
    return F.greatest(claimed, real)
