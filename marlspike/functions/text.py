"""Text normalisers as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ARTICLES = ("a", "an", "the")
NO_INFO = "No relevant information found"
#: Fixed answers that stand for "nothing found", lower case.
UNKNOWN_ANSWERS = ("no relevant information found", "unable to determine.", "unable to determine", "cannot determine", "unknown")
CLOSED_ANSWERS = ("yes", "no", "insufficient information")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def recall_tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*ARTICLES))


def recall_form(text: Column) -> Column:
    """Normal form for inclusion tests: punctuation is a separator, articles go."""
    return F.array_join(recall_tokens(text), " ")


def answer_tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: ~w.isin("", *ARTICLES))


def answer_form(text: Column) -> Column:
    """Normal form for answers: ASCII punctuation is deleted, articles go."""
    return F.array_join(answer_tokens(text), " ")


def sentences(text: Column) -> Column:
    """Pieces between white space that follows a full stop, question or exclamation mark."""
    return F.filter(F.transform(F.split(text, r"(?<=[.?!])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def without_thoughts(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def thought(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    return F.when(text.rlike(r"(?s)<think>.*?</think>"), strip(found))


def sub_query(text: Column) -> Column:
    """A generated sub-query without thoughts, quotes and labels."""
    bare = without_thoughts(text)
    bare = F.regexp_replace(bare, r'(?s)^"(.*)"$', "$1")
    bare = F.regexp_replace(bare, r"^Intermediate query \d+: ", "")
    return strip(F.regexp_replace(bare, r"(?i)^(SubQuery|Query)\s*:\s*", ""))


def _canonical(answer: Column) -> Column:
    low = F.lower(answer)
    return F.when(low.isin(*CLOSED_ANSWERS), low).when((answer == "") | low.isin(*UNKNOWN_ANSWERS), NO_INFO).otherwise(answer)


#: Fixed labels of an answer, each of which starts it anew, and those that go wherever they stand.
ANSWER_LABELS = ("Final Answer:", "SubAnswer:", "Answer:")
STEP_LABELS = "SubQuery|SubAnswer|Intermediate query|Intermediate answer"


def sub_answer(text: Column) -> Column:
    """What follows the last answer label, in canonical form; empty stays empty."""
    bare = without_thoughts(text)
    for label in ANSWER_LABELS:
        bare = strip(F.element_at(F.split(bare, label), -1))
    bare = strip(F.regexp_replace(bare, r"(?i)^(SubAnswer|Answer)\s*:\s*", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(_canonical(bare))


def final_answer(text: Column) -> Column:
    """The last line that isn't empty, without labels, in canonical form."""
    bare = strip(F.element_at(F.split(without_thoughts(text), "Final Answer:"), -1))
    bare = F.regexp_replace(bare, rf"(?i)\b({STEP_LABELS})\s*:\s*", "")
    lines = F.filter(F.transform(F.split(bare, r"\r\n|\n|\r"), lambda x: strip(x)), lambda x: x != "")
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(strip(bare))
    last = strip(F.regexp_replace(last, r"(?i)^(Final Answer|Answer)\s*:\s*", ""))
    low = F.lower(last)
    known = F.when(low.isin(*UNKNOWN_ANSWERS) | low.contains(NO_INFO.lower()), NO_INFO).when(low.isin(*CLOSED_ANSWERS), low).otherwise(last)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(known)


#: Fixed labels of the parts of a model's answer, in the order they are looked for.
PART_LABELS = ("Final Answer:", "SubAnswer:", "SubQuery:")


def model_answer(text: Column) -> Column:
    """The answer in a model's text: what follows the last label of the first kind found, up to the next label, unquoted, in canonical form.

    Null and what is left empty have no information.
    """
    bare = without_thoughts(F.coalesce(text, F.lit("")))
    out = bare
    for label in reversed(PART_LABELS):
        parts = F.regexp_extract_all(bare, F.lit(rf"(?is){label}\s*(.*?)(?=\n\s*(?:SubQuery|SubAnswer|Final Answer)\s*:|$)"), F.lit(1))
        out = F.when(F.size(parts) > 0, strip(F.element_at(parts, -1))).otherwise(out)
    out = strip(F.regexp_replace(out, r"(?i)^\s*(?:Final Answer|SubAnswer|SubQuery|Answer)\s*:\s*", ""))
    out = strip(F.regexp_replace(out, r"""(?s)^(["'])(.*)\1$""", "$2"))
    return _canonical(out)


#: Fixed titles that are taken off an answer's start.
HONORIFICS = (
    r"Queen|King|Emperor|Empress|Prince|Princess|Grand\s+Duke|Grand\s+Duchess|Duke|Duchess|Count|Countess|Earl|Baron|Baroness|Lord|Lady|Sir|Dame|Saint|St\."
)


def answer_entity(text: Column) -> Column:
    """The first entity of an answer: what stands before ; or and , without an honorific."""
    bare = strip(F.regexp_replace(sub_answer(text), r"\s+", " "))
    bare = strip(F.regexp_replace(bare, r"^\.+|\.+$", ""))
    for separator in ("; ?", " or ", " and ", ","):
        bare = strip(F.element_at(F.split(bare, separator), 1))
    bare = strip(F.regexp_replace(bare, rf"(?i)^(?:{HONORIFICS})\s+", ""))
    return F.when(sub_answer(text).isin("", NO_INFO), "").otherwise(bare)


#: Fixed rewrites of questions, in the order they apply.
FOLLOW_UPS = (
    (r"(?i)^Who is the nationality of (.+?)\?$", "What nationality is $1?"),
    (r"(?i)^Who is the country of origin for (.+?)\?$", "Which country is $1 from?"),
    (r"(?i)^Who is the country of (.+?)\?$", "Which country is $1 from?"),
    (r"(?i)^What country is the origin of (?:(?:the|a) )?(?:movie|film|song|album|show|series)\s+(.+?)\?$", "Which country is $1 from?"),
    (r"(?i)^What country did (?:(?:the|a) )?(?:movie|film|song|album|show|series)\s+(.+?) originate from\?$", "Which country is $1 from?"),
    (r"(?i)^Who was the father of (.+?)\?$", "Who is the father of $1?"),
    (r"(?i)^Who was the mother of (.+?)\?$", "Who is the mother of $1?"),
    (r"(?i)^Who was (.+?)'s (husband|wife|spouse|father|mother)\?$", "Who is $1's $2?"),
    (r"(?i)^Who is the child-in-law of (.+?)\?$", "Who is $1's child?"),
)


def follow_up(text: Column) -> Column:
    out = strip(text)
    for pattern, to in FOLLOW_UPS:
        out = F.regexp_replace(out, pattern, to)
    return strip(F.regexp_replace(out, r"\s+", " "))


def canonical_query(text: Column) -> Column:
    """A search query without thoughts, labels and quotes, in the wording that the rewrites use."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", " ")
    out = strip(F.regexp_replace(out, r"(?i)^(?:\s*(?:SubQuery|SubAnswer|Final Answer|Intermediate query \d+)\s*:\s*)+", ""))
    for pattern, to in (FOLLOW_UPS[0], FOLLOW_UPS[1], FOLLOW_UPS[2], FOLLOW_UPS[5], FOLLOW_UPS[6]):
        out = F.regexp_replace(out, pattern, to)
    out = F.translate(F.translate(out, "“”", '""'), "’", "'")
    return strip(F.regexp_replace(F.regexp_replace(out, '"', ""), r"\s+", " "))


def truncated_middle(tokens: Column, most: int) -> Column:
    """The first and last halves of a token array that is longer than ``most``."""
    head = most // 2
    cut = F.concat(F.slice(tokens, 1, head), F.slice(tokens, F.size(tokens) - (most - head) + 1, most - head))
    return F.when(F.size(tokens) > most, cut).otherwise(tokens)


def score_in(text: Column) -> Column:
    """The first 1, 1.0.. or 0.dd of a judgement, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"1(\.0{1,2})?|0(\.\d{1,2})?", 0).try_cast("double"), F.lit(0.0))


def question_lines(text: Column) -> Column:
    """Lines without a leading question label; empty ones go."""
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*问题\s*\d+\s*[：:]\s*", "")))
    return F.filter(lines, lambda x: x != "")


def numbered_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d"))


def json_tail(text: Column) -> Column:
    """The text from the first [ that its last list opens with to the last ]."""
    return F.regexp_extract(text, r"(?s)(\[.*\])", 1)


def table_rows(header: Column, cells: Column) -> Column:
    """header:value pairs of a row, joined by commas and ended by a full stop."""
    return F.concat(F.array_join(F.zip_with(header, cells, lambda h, c: F.concat_ws(":", h, c)), ","), F.lit("。"))


def excel_time(serial: Column) -> Column:
    """HH:MM of a day's fraction."""
    return F.date_format(F.timestamp_seconds(F.round(serial * 86400)), "HH:mm")
