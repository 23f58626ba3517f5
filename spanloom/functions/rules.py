"""Rules over metric columns and lines: quality scores, policies and metadata filters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import bound
from .text import basic, has_credit, is_promo, is_symbols_only

#: Beginnings of lines that are credits.
PREFIXES = (
    "artist:", "song:", "title:", "album:", "writer:", "composer:", "lyricist:", "lyrics by", "written by", "produced by", "music by", "source:", "contributor:", "arranged by", "performed by", "vocals by",
    "music and lyrics", "words and music",
    "作词", "作詞", "作曲", "编曲", "編曲", "制作人", "演唱", "歌手", "词:", "曲:", "词 :", "曲 :",
    "saku:", "saku :", "sakkyoku:", "sakkyoku :", "sakushi:", "sakushi :", "henkyoku:", "henkyoku :", "kashu:", "kashu :",
    "작사:", "작곡:", "편곡:",
)
#: Words that are credits before a colon and a name.
KEYWORDS = ("composer", "lyricist", "writer", "arranger", "producer", "saku", "sakkyoku", "sakushi", "henkyoku")
#: Parts of lines that are no lyrics.
SECTIONS = (
    "all rights reserved", "copyright", "℗", "©", "(instrumental)", "[instrumental]", "(intro)", "[intro]", "(outro)", "[outro]", "(verse)", "[verse]", "(chorus)", "[chorus]", "(bridge)", "[bridge]", "(hook)", "[hook]",
)


def has_prefix(line: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """Whether a line begins, in any case, with one of the prefixes."""
    low = F.lower(F.trim(line))
    out = F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p)
    return out


def has_part(line: Column, parts: tuple[str, ...] = SECTIONS) -> Column:
    low = F.lower(line)
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def has_keyword(line: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Whether a line holds, in any case, a keyword as a word of its own, a colon and a letter a to z."""
    return line.rlike(rf"(?i)\b({'|'.join(keywords)})\s*:\s*[a-z]")


def repeats_title(line: Column, title: Column, least: int = 24, beyond: int = 8) -> Column:
    """Whether a line advertises its title: it names it twice, or once, not in front, in quotes or in a sentence (ended by
    . ! or ?) that is long enough. An empty title is in no line."""
    low, name = F.lower(line), F.lower(title)
    found = F.position(name, low)
    twice = F.position(name, F.substring(low, found + F.length(name), F.length(low))) > 0
    in_front = F.startswith(F.regexp_replace(low, "^[ \"'“”‘’(]+", ""), name)
    head, tail = F.substring(low, F.lit(1), found - 1), F.substring(low, found + F.length(name), F.length(low))
    quoted = head.rlike("[\"“”]") & tail.rlike("[\"“”]")
    long = F.length(low) >= F.greatest(F.lit(least), F.length(name) + beyond)
    once = ~in_front & (quoted | F.trim(line).rlike("[.!?]$")) & long
    return F.coalesce((F.length(name) > 0) & (found > 0) & (twice | once), F.lit(False))


#: Further spellings of one artist, which any line that holds them is a header of.
ARTIST_SPELLINGS = ("blueöystercult", "blueoystercult", "blueoyster", "b.o.c", "boc")


def is_title_header(line: Column, title: Column, artist: Column, more: int = 10) -> Column:
    """Whether a line is the title, or holds it and fewer than ``more`` further characters, or is title and artist in either
    order; without spaces, apostrophes and parentheses, in any case. An empty title heads nothing."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[ '()]", "")
    x, t, a = bare(line), bare(title), bare(artist)
    within = F.contains(x, t) & (F.length(x) < F.length(t) + more)
    both = (F.coalesce(F.length(artist), F.lit(0)) > 0) & ((x == F.concat(t, a)) | (x == F.concat(a, t)))
    return F.coalesce((F.length(title) > 0) & ((x == t) | within | both), F.lit(False))


def is_artist_header(line: Column, artist: Column, spellings: tuple[str, ...] = ARTIST_SPELLINGS) -> Column:
    """Whether a line holds the artist's name, or one of ``spellings``: without spaces, ö and ü as o and u. An empty artist
    heads nothing."""
    bare = lambda c: F.translate(F.replace(F.lower(c), F.lit(" ")), "öü", "ou")
    x = bare(line)
    out = F.contains(x, bare(artist))
    for v in spellings:
        out = out | F.contains(x, F.lit(v))
    return F.coalesce((F.length(artist) > 0) & out, F.lit(False))


def is_metadata(line: Column, title: Column, artist: Column, at: Column, header: float = 1.0, promotion: float = 12.0, title_sentence: float = 15.0, promos: bool = True) -> Column:
    """Whether a line is no lyrics: blank or symbols only, or a credit or section mark; a header of title or artist up to
    second ``header``; promotion up to second ``promotion``, and a sentence that advertises the title up to second
    ``title_sentence``, unless ``promos`` is off. An unknown time counts as the beginning."""
    when = F.coalesce(at.cast("double"), F.lit(-1.0))
    out = is_symbols_only(line) | has_prefix(line) | has_keyword(line) | has_part(line) | has_credit(line)
    out = out | ((when <= header) & (is_title_header(line, title, artist) | is_artist_header(line, artist)))
    if promos:
        out = out | ((when <= promotion) & is_promo(line)) | ((when <= title_sentence) & repeats_title(line, title))
    return F.coalesce(out, F.lit(False))


#: Parts of words that providers and owners leave on a screen, and beginnings and ends of such words.
OWNERS = ("karaoke", "karafun", "entertainer", "digitop", "rights", "reserved", "copyright", "produced", "association", "global", "ltd", "www", "http")
PROVIDERS, ADDRESSES = ("kara", "xara", "xora"), ("com", "couk", "net")


def is_screen_noise(text: Column) -> Column:
    """Whether a line on screen names its provider or owner: an address beside such a word, three words with a part of
    OWNERS, or two of PROVIDERS, or two of either kind among ten words. Null and empty texts are none."""
    count = lambda words, test: F.size(F.filter(words, test))
    each = F.filter(F.transform(F.split(basic(text), " "), lambda w: F.regexp_replace(w, "[^a-z0-9]+", "")), lambda w: w != "")
    tallies = bound(each, lambda words: F.struct(
        F.size(words).alias("n"), count(words, lambda w: w.rlike("|".join(OWNERS))).alias("owners"),
        count(words, lambda w: w.rlike(f"^({'|'.join(PROVIDERS)})") & (F.length(w) >= 5)).alias("providers"), count(words, lambda w: w.rlike(f"www|({'|'.join(ADDRESSES)})$")).alias("addresses"),
    ))

    def noise(c: Column) -> Column:
        n, owners, providers, addresses = (c[k] for k in ("n", "owners", "providers", "addresses"))
        return (addresses >= 1) & ((owners >= 1) | (providers >= 1)) | (owners >= 3) | (providers >= 2) & (n >= 2) | (n >= 10) & ((owners >= 2) | (providers >= 2))

    return F.coalesce(bound(tallies, noise), F.lit(False))


#: Parts of titles of versions that no studio made.
NON_STUDIO = (
    "live", "concert", "performance", "performs", "performing", "tour", "in concert", "acoustic", "unplugged", "stripped", "piano version", "remix", "extended", "extended mix", "demo", "rehearsal", "bootleg", "outtake", "alternate take",
    "cover", "tribute", "karaoke", "instrumental", "reaction", "tutorial", "lesson", "how to play", "guitar lesson", "slowed", "sped up", "reverb", "8d audio", "nightcore", "bass boosted", "session", "sessions", "bbc session", "peel session",
    "maida vale", "parody", "weird al",
)
#: Patterns of places, shows and years of performances.
PERFORMANCES = (
    r"\bat\b.*\b(show|festival|arena|stadium|hall|theater|theatre|club|center|centre)\b", r"\blive\s+(at|from|in)\b", r"\b(snl|saturday night live|letterman|fallon|kimmel|conan|ellen|tonight show)\b",
    r"\b(jools holland|later with|top of the pops|totp|graham norton)\b", r"\b(tiny desk|npr|kexp|colors?\s*show|a]colors)\b", r"\b(glastonbury|coachella|lollapalooza|reading|leeds|bonnaroo)\b",
    r"\b(rock am ring|download|download festival|wacken|hellfest)\b", r"\b(south by southwest|sxsw|austin city limits|acl)\b", r"\b(mtv|vma|grammy|grammys|brit awards?|ama|american music)\b", r"\b(billboard|bet awards|iheartradio)\b",
    r"\b(unplugged|stripped|acoustic sessions?)\b", r"\b(spotify\s*sessions?|apple\s*music\s*sessions?)\b", r"\b(19|20)[0-9]{2}\s+(tour|live|concert|performance)\b",
)
#: Edits that studios make, and radio shows, which aren't such edits.
STUDIO_EDIT = r"\b(single|radio|album)\s*(edit|version)?\b"
RADIO_SHOWS = (r"radio\s*[0-9]", r"radio\s+session", r"bbc\s+radio", r"radio\s+show")


def is_non_studio(title: Column) -> Column:
    """Whether a title tells of a live, covered or altered version. A single, album or radio edit is none, unless the radio
    is a show's. Null is unknown, so not."""
    low = F.lower(title)
    edit = low.rlike(STUDIO_EDIT) & ~(F.contains(low, F.lit("radio")) & low.rlike("|".join(RADIO_SHOWS)))
    return F.coalesce(~edit & (has_part(title, NON_STUDIO) | low.rlike("|".join(PERFORMANCES))), F.lit(False))


def expanded_tokens(tokens: Column, forms: dict[str, str]) -> Column:
    """Tokens replaced by their long forms (which may be several words), then flat again."""
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return F.flatten(F.transform(tokens, lambda w: F.split(F.coalesce(F.try_element_at(table, w), w), " ")))


def collapsed_runs(tokens: Column, fillers: tuple[str, ...]) -> Column:
    """Without fillers that repeat the token before them."""
    keep = lambda w, k: ~(w.isin(*fillers) & (k > 0) & (w == F.get(tokens, k - 1)))
    return F.filter(tokens, lambda w, k: F.coalesce(keep(w, k), F.lit(True)))


def stripped_ends(tokens: Column, fillers: tuple[str, ...]) -> Column:
    """Without fillers at either end, however many."""
    kept = F.transform(tokens, lambda w, k: F.when(~w.isin(*fillers), k))
    first, last = F.array_min(kept), F.array_max(kept)
    return F.when(first.isNotNull(), F.slice(tokens, first + 1, last - first + 1)).otherwise(F.array().cast("array<string>"))
