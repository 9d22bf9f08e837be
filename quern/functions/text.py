"""Text functions: normalisation, tokens, character trigrams, excerpts, titles."""

from __future__ import annotations

import unicodedata

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that counts inside regular expressions (vertical tab is not one).
BLANK = r"[\t\n\f\r ]"
NOT_BLANK = r"[^\t\n\f\r ]"


#: The form of a text's letters in which words are compared: ICU's compatibility
#: decomposition, marks dropped.  Rows and queries go through the same JVM functions.
_DECOMPOSE = "com.ibm.icu.text.Normalizer"
_MARKS, _GAPS = r"\p{Mn}+", r"[^\p{L}\p{Nd}]+"


def normalize(text: Column) -> Column:
    """Lower-case per character, NFKD, drop non-spacing marks; what is neither letter
    nor decimal digit becomes one space; trimmed.  The same for every script."""
    # the final sigma is the one letter that lower-casing a string makes depend on its neighbours
    # (replaced as a string: ``translate`` looks every letter up)
    low = F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))
    full = F.regexp_replace(F.reflect(F.lit(_DECOMPOSE), F.lit("decompose"), low, F.lit(True)), _MARKS, "")
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(full), _GAPS, " "))


def normalize_text(text: str) -> str:
    """:func:`normalize` of one string on the driver: with the session's JVM where there is one,
    else with Python's own tables, which may know newer characters."""
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jvm is not None:
        jvm = sc._jvm
        full = getattr(jvm, _DECOMPOSE).decompose(jvm.java.lang.String(text.replace("Σ", "σ").lower()), True)
        replace = lambda pattern, s, by: jvm.java.util.regex.Pattern.compile(pattern).matcher(s).replaceAll(by)
        return replace(_GAPS, replace(_MARKS, full, ""), " ").strip(" ")
    kinds = [(c, unicodedata.category(c)) for c in unicodedata.normalize("NFKD", text.replace("Σ", "σ").lower())]
    return " ".join("".join(c if k[0] == "L" or k == "Nd" else " " for c, k in kinds if k != "Mn").split())


def tokens(normalized: Column) -> Column:
    """Words of a normalised text, repeats included."""
    return F.array_remove(F.split(normalized, " "), "")


def grams_of(words: Column) -> Column:
    """The set of three-character runs of the words; shorter words stand for themselves."""

    def of_word(w: Column) -> Column:
        last = F.greatest(F.lit(1), F.char_length(w) - 2)
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, F.least(F.lit(3), F.char_length(w))))

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words), of_word)))


def gram_set(text: Column) -> Column:
    return grams_of(tokens(normalize(text)))


def grams_text(grams: Column) -> Column:
    """Sorted and joined by spaces, the stored form."""
    return F.array_join(F.array_sort(grams), " ")


def similarity(query_grams: Column, grams: Column) -> Column:
    """Share of the query's trigrams that a text has; 0 if either set is empty."""
    both = F.size(F.array_intersect(query_grams, grams)).cast("double")
    return F.when((F.size(query_grams) == 0) | (F.size(grams) == 0), F.lit(0.0)).otherwise(both / F.size(query_grams))


def query_tokens(query: str) -> list[str]:
    return normalize_text(query).split()


def query_grams(query: str) -> list[str]:
    found: dict[str, None] = {}
    for w in query_tokens(query):
        for i in range(max(1, len(w) - 2)):
            found.setdefault(w[i : i + 3])
    return list(found)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def _shorten(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def excerpt(text: Column, most: int = 320) -> Column:
    return _shorten(one_line(text), most)


def first_line_title(text: Column, most: int = 100) -> Column:
    line = one_line(F.substring_index(F.regexp_replace(text, rf"^{BLANK}+", ""), "\n", 1))
    return F.when(F.coalesce(line, F.lit("")) == "", F.lit("Untitled session")).otherwise(_shorten(line, most))


def shell_quote(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


#: Command by which a session is taken up again, per harness (fixed formats).
RESUME = {
    "pi": "pi --session {id}",
    "codex": "codex resume {id}",
    "claude": "claude --resume {id}",
    "opencode": "opencode --session {id}",
}


def resume_hint(harness: Column, native_id: Column, cwd: Column) -> Column:
    """``cd 'cwd' && command``; without a directory only the command; '' for an unknown harness."""
    said = F.lit(None).cast("string")
    for name, form in RESUME.items():
        before, after = form.split("{id}")
        said = F.when(harness == name, F.concat(F.lit(before), shell_quote(native_id), F.lit(after))).otherwise(said)
    there = F.when(F.coalesce(cwd, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("cd "), shell_quote(cwd), F.lit(" && ")))
    return F.coalesce(F.concat(there, said), F.lit(""))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


