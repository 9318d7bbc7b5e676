"""Tokenizer for multilingual social-media text."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: what counts as a token of each kind ---
URL = r"https?://\S+|www\.\S+|[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}(?:/\S*)?"
EMAIL = r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b"
MENTION = r"@\w+"
HASHTAG = r"#\w+"
CASHTAG = r"\$[a-z]{1,5}\b"
#: Emoticons; pictographs; transport; regional indicators; dingbats; supplemental pictographs; miscellaneous symbols.
EMOJI = r"[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F1E0-\U0001F1FF\u2700-\u27BF\U0001F900-\U0001F9FF\u2600-\u26FF]"
#: Ordinals; amounts after a sign of dollar, euro, pound, yen, rupee, rouble, cent; grouped numbers; plain ones.
NUMERIC = r"\d+(?:st|nd|rd|th)(?!\w)|[$\u20AC\u00A3\u00A5\u20B9\u20BD\u00A2]\d+(?:[.,]\d+)*|\d+(?:[.,]\d+)+|\d+\.?\d*%?"
#: Dotted abbreviations; ASCII words with hyphens, apostrophes (U+2019 too) and backticks.
LATIN = r"[a-z]+(?:\.[a-z]+)+\.?|[a-z]+(?:[-'\u2019`][a-z]+)*[-'\u2019`]?"
#: Hangul syllables and the rest of their block.
HANGUL = r"[\uAC00-\uD7AF]+"
#: Han, Han extension A, hiragana, katakana, Hangul.
IDEOGRAPHS = r"[\u4E00-\u9FFF\u3400-\u4DBF\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF]+"
#: Arabic, its supplement, its extension A.
ARABIC = r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF]+"
THAI = r"[\u0E00-\u0E7F]+"
#: Khmer, Myanmar, Buginese, Balinese.
SOUTHEAST_ASIAN = r"[\u1780-\u17FF\u1000-\u109F\u1A00-\u1A1F\u1B00-\u1B7F]+"
PUNCTUATION = r"[.!?;:,\-()\[\]{}\"']"
#: Scripts whose characters are tokens: Han, Han extension A, hiragana, katakana, Thai, Lao, Myanmar, Khmer.
CHARACTER_SCRIPTS = r"\u4E00-\u9FFF\u3400-\u4DBF\u3040-\u309F\u30A0-\u30FF\u0E00-\u0E7F\u0E80-\u0EFF\u1000-\u109F\u1780-\u17FF"
#: Tokens of these alone are emoji: emoticons, pictographs, transport, regional indicators, miscellaneous
#: symbols, dingbats, supplemental and extended pictographs; joiner, variation selectors 15 and 16, tags.
EMOJI_ONLY = r"[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F1E6-\U0001F1FF\u2600-\u26FF\u2700-\u27BF\U0001F900-\U0001F9FF\U0001FA70-\U0001FAFF\u200D\uFE0E\uFE0F\U000E0020-\U000E007F]+"
URL_TAIL = ".!?;:,)]}\"'"
ABBREVIATION = r"[a-z]{1,3}(?:\.[a-z]{1,3})+\.?"
# --- end of fixed values ---

_WORDS = "|".join((LATIN, HANGUL, IDEOGRAPHS, ARABIC, THAI, SOUTHEAST_ASIAN))
_character = regex.compile(f"[{CHARACTER_SCRIPTS}]")
_parts = regex.compile(f"[{CHARACTER_SCRIPTS}]|[^{CHARACTER_SCRIPTS}]+")
_emoji_only = regex.compile(EMOJI_ONLY)
_abbreviation = regex.compile(ABBREVIATION, regex.IGNORECASE)
_ascii_letter = regex.compile("[a-zA-Z]")


@dataclass(frozen=True)
class TokenizerConfig:
    """What becomes a token.

    Hashtags, mentions and cashtags that are switched off fall apart into
    words; URLs, e-mails and numbers that are switched off vanish.
    ``case`` is lower, upper, preserve or normalize (the same as lower).
    """

    include_punctuation: bool = False
    include_numeric: bool = True
    include_emoji: bool = False
    case: str = "lower"
    normalize_unicode: bool = False
    extract_hashtags: bool = True
    extract_mentions: bool = True
    extract_cashtags: bool = True
    include_urls: bool = True
    include_emails: bool = True
    min_token_length: int = 1
    max_token_length: int | None = None
    strip_whitespace: bool = True


DEFAULT = TokenizerConfig()


@functools.lru_cache(maxsize=64)
def _patterns(config: TokenizerConfig):
    kinds = [
        (config.include_urls, URL),
        (config.include_emails, EMAIL),
        (config.extract_mentions, MENTION),
        (config.extract_hashtags, HASHTAG),
        (config.extract_cashtags, CASHTAG),
        (config.include_emoji, EMOJI),
        (config.include_numeric, NUMERIC),
        (True, _WORDS),
        (config.include_punctuation, PUNCTUATION),
    ]
    off = [p for on, p in ((config.include_urls, URL), (config.include_emails, EMAIL), (config.include_numeric, NUMERIC)) if not on]
    names = {URL: "link", _WORDS: "word"}
    union = lambda parts: regex.compile("|".join(f"(?P<{names[p]}>{p})" if p in names else f"(?:{p})" for p in parts), regex.IGNORECASE)
    return union([p for on, p in kinds if on]), union(off) if off else None


def _without_tail(match: regex.Match) -> str:
    """The matched token; links lose the punctuation behind them.

    A link is what the alternative of links found, unless it holds an address
    with ``@``; and a dotted word that is too long for an abbreviation.
    """
    token = match[0]
    address = "@" in token and "." in token
    if match.lastgroup == "link" and not address or match.lastgroup == "word" and token[-1] == "." and not _abbreviation.fullmatch(token):
        return token.rstrip(URL_TAIL)
    return token


def _by_script(token: str) -> list[str]:
    """Character-level scripts one by one; a word that mixes them with ASCII stays whole."""
    if not _character.search(token) or (token[0] not in "@#$" and _ascii_letter.search(token)):
        return [token]
    return _parts.findall(token)


def tokenize_text(text: str | None, config: TokenizerConfig = DEFAULT) -> list[str]:
    """Tokens in the order of the text; none for null or blank texts.

    A text without any token is itself the one token, stripped.
    """
    if not text:
        return []
    if config.normalize_unicode:
        text = unicodedata.normalize("NFKC", text)
    if config.case in ("lower", "normalize"):
        text = text.lower()
    elif config.case == "upper":
        text = text.upper()
    wanted, unwanted = _patterns(config)
    if unwanted:
        text = " ".join(unwanted.sub(" ", text).split())
    found = [m for m in wanted.finditer(text) if not m[0].isspace()]
    if found:
        found = [part for m in found for part in _by_script(_without_tail(m))]
    elif text.strip():
        found = [text.strip()]
    out = []
    for token in found:
        token = token.strip() if config.strip_whitespace else token
        if not token.strip() or (not config.include_emoji and _emoji_only.fullmatch(token)):
            continue
        if len(token) >= config.min_token_length and (config.max_token_length is None or len(token) <= config.max_token_length):
            out.append(token)
    return out


def tokenize(text: Column | str, config: TokenizerConfig = DEFAULT) -> Column:
    """Array of tokens; Arrow-batched, as Unicode normal forms have no SQL function."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenize_text(t, config))

    return tokens(text)


def tokenize_ascii(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits, all in SQL functions."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
