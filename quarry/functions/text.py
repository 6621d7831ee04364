"""Text expressions: cleaning (F11), word counts (F12), context prefix (F13),
slugs (F17), list joins (F19), Python-style strip (N10).  All JVM-side."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for equal results) -----------------
# Stop words of the single-crop clustering script, in the reference's order.
STOP_WORDS_TEXT = """
a an the in on of for to at by from with and or is are am was were be been being have has had
do does did can could shoud would will may might must
mein me mai main ko ka ki ke se ne par per pe he hai hain ha hi ho h tha thi the hu hun hoon
kya kyon kab kaise kaha kahan kon kaun kis kisi kisko kisse
liye liya lie laye wale wali wala aur tatha evam bhi to agar magar lekin parantu
kare karen karein karna karne kar karo kiya kiye jay jaye jana jane jata jati jate
lag laga lagi lage lga lgi lge lagna lagne aa aaya aaye raha rahi rahe rha rhi rhe
ho hona hone honi pad pd padi pdi padta padti padte gaya gyi gaye gye gay gayi
chahiye chahie chahye sakta sakti sakte sake saka
bataye batayen batain batao bataiye btaye btao bata de den dijiye dijiya dein
dal dala dale dalen dalna dalne dali dalo use using used apply applied applying spray spraying
crop phasal fasal kheti farm farming farmer kisan agriculture krishi
plant paudha podha paudh podh ped field khet seed beej seeds
variety var varieties kism prajati prajatiyan type
dhan paddy rice chawal gehu wheat ganna sugarcane makka maize bajra millet aloo potato tamatar tomato
ji sir madam mam mr bhai bhaiya
question query problem samasya issue doubt help info information jankari detail details
about regarding related want know please pls plz provide tell ask asked asking
solution upchar ilaaj ilaj dawa medicine control roktham nidan upay management niyantran
matra quantity dose amount rate price bhav rate muly
number no contact mobile
"""
# The clustering engine's list is the same plus this greeting.
ENGINE_EXTRA_STOP_WORDS = ("namaste",)
# Characters removed by Python's str.strip() that SQL trim() keeps (ASCII part).
PY_WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
# --------------------------------------------------------------------------------

STOP_WORDS: tuple[str, ...] = tuple(dict.fromkeys(STOP_WORDS_TEXT.split()))
ENGINE_STOP_WORDS: tuple[str, ...] = STOP_WORDS + ENGINE_EXTRA_STOP_WORDS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """Python ``str.strip()`` (blanks, tabs, line ends), unlike SQL ``trim``."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def normalize_key(col: Column | str) -> Column:
    """``str(x).lower().strip()`` used for name lookups."""
    return py_strip(F.lower(_c(col).cast("string")))


def letters_only(col: Column | str) -> Column:
    """lower -> non-letters to blank -> collapse blanks -> strip; null -> '' (N4)."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    c = F.regexp_replace(F.lower(c), r"[^a-zA-Z\s]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_tokens(col: Column | str, stop_words: Iterable[str] | None = STOP_WORDS) -> Column:
    """F11 as an array of tokens (stop words removed).  What replacing, collapsing, stripping and
    splitting leave are the runs of letters, found in one regex pass over every text."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z]+"), F.lit(0))
    stops = list(stop_words or ())
    return F.filter(words, lambda t: ~t.isin(stops)) if stops else words


def valid_tokens(df: DataFrame, col: str, name: str, stop_words: Iterable[str] | None = STOP_WORDS) -> DataFrame:
    """the rows that keep a token, with their tokens.  A generator of no or one row, where a filter
    would be pushed below the column and clean every text a second time."""
    tokens = F.array(clean_tokens(col, stop_words))
    return df.select("*", F.explode(F.filter(tokens, lambda t: F.size(t) > 0)).alias(name))


def clean_text(col: Column | str, stop_words: Iterable[str] | None = STOP_WORDS) -> Column:
    """F11 ``preprocess_text``: the cleaned string (tokens joined by one blank)."""
    return F.array_join(clean_tokens(col, stop_words), " ")


def word_count(cleaned: Column | str) -> Column:
    """Number of blank-separated words; '' has 0 words."""
    return F.size(F.filter(F.split(_c(cleaned), " "), lambda t: t != F.lit("")))


def context_prefix(crop: Column | str, text: Column | str) -> Column:
    """encoder input ``Crop: {crop}, Query: {text}``."""
    return F.format_string("Crop: %s, Query: %s", _c(crop), _c(text))


def file_slug(col: Column | str) -> Column:
    """drop parentheses, '/' and blanks become '_' (other characters kept)."""
    return F.translate(F.regexp_replace(_c(col), r"[()]", ""), "/ ", "__")


def sheet_label(col: Column | str) -> Column:
    """K3 partition label: first 31 characters, '/' and '\\' become '_'."""
    return F.translate(F.substring(_c(col).cast("string"), 1, 31), "/\\", "__")


def join_list(col: Column | str, sep: str = ", ") -> Column:
    """F19."""
    return F.array_join(_c(col), sep)


def truncate_label(col: Column | str, width: int) -> Column:
    """names longer than ``width`` are cut to ``width`` characters + '...'."""
    c = _c(col)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def compact_number(col: Column | str) -> Column:
    """1234567 -> '1.2M', 45300 -> '45.3k', smaller numbers as digits."""
    c = _c(col).cast("double")
    return (F.when(c >= 1_000_000, F.concat(F.format_number(c / 1_000_000, 1), F.lit("M")))
            .when(c >= 1_000, F.concat(F.format_number(c / 1_000, 1), F.lit("k")))
            .otherwise(_c(col).cast("bigint").cast("string")))


def thousands(col: Column | str) -> Column:
    """integer with thousands separators (``f'{x:,}'``)."""
    return F.format_number(_c(col).cast("bigint"), 0)
