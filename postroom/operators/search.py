"""Message search: facets, and full text with stems, phrases, ranks and headlines."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.operators.ordering import asc, desc
from postroom.operators.views import contains

LIMIT = 200
# Orders that may be asked for; nulls as row stores place them.
ORDERINGS = {
    "-sent_at": lambda c: [desc("sent_at"), asc("message_id", c)],
    "sent_at": lambda c: [asc("sent_at"), asc("message_id", c)],
    "sender": lambda c: [asc("sender_email", c), desc("sent_at"), asc("message_id", c)],
    "-sender": lambda c: [desc("sender_email", c), desc("sent_at"), asc("message_id", c)],
    "subject": lambda c: [asc("subject_normalized", c), desc("sent_at"), asc("message_id", c)],
    "-subject": lambda c: [desc("subject_normalized", c), desc("sent_at"), asc("message_id", c)],
    "attachment_count": lambda c: [asc("attachment_count"), desc("sent_at"), asc("message_id", c)],
    "-attachment_count": lambda c: [desc("attachment_count"), desc("sent_at"), asc("message_id", c)],
    "references_depth": lambda c: [asc("references_depth"), desc("sent_at"), asc("message_id", c)],
    "-references_depth": lambda c: [desc("references_depth"), desc("sent_at"), asc("message_id", c)],
    "quoted_line_count": lambda c: [asc("quoted_line_count"), desc("sent_at"), asc("message_id", c)],
    "-quoted_line_count": lambda c: [desc("quoted_line_count"), desc("sent_at"), asc("message_id", c)],
    "-rank": lambda c: [desc("rank"), desc("sent_at"), asc("message_id", c)],
}


@dataclass
class SearchParameters:
    """What a search form can ask for; None asks for nothing."""

    q: str | None = None
    sender: str | None = None
    subject: str | None = None
    body: str | None = None
    message_id: str | None = None
    thread_root: str | None = None
    in_reply_to: str | None = None
    mime_type: str | None = None
    sent_from: str | None = None
    sent_to: str | None = None
    has_attachments: bool | None = None
    parse_ok: bool | None = None
    is_response: bool | None = None
    is_forward: bool | None = None
    has_html: bool | None = None
    attachment_count: tuple[str | int | None, str | int | None] = (None, None)
    references_depth: tuple[str | int | None, str | int | None] = (None, None)
    quoted_line_count: tuple[str | int | None, str | int | None] = (None, None)
    order: str | None = None
    limit: int | None = LIMIT
    collation: str | None = None


def _number(value) -> int | None:
    """Whole numbers count; anything else is as if it were not asked for."""
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def facet_filter(messages: DataFrame, p: SearchParameters) -> DataFrame:
    """Rows that meet all that is asked for; each test is a plain filter, so Catalyst can push it."""
    tests: list[Column] = []
    for column, text in (("sender_email", p.sender), ("subject_normalized", p.subject), ("body_clean", p.body), ("message_id", p.message_id), ("thread_root_message_id", p.thread_root), ("in_reply_to", p.in_reply_to), ("mime_type", p.mime_type)):
        if text:
            tests.append(contains(column, text))
    for text, test in ((p.sent_from, lambda t: F.col("sent_at") >= t), (p.sent_to, lambda t: F.col("sent_at") <= t)):
        if text:
            tests.append(test(F.lit(datetime.fromisoformat(text))))  # raises ValueError if it is no date
    for column in ("has_attachments", "parse_ok", "is_response", "is_forward"):
        if (wanted := getattr(p, column)) is not None:
            tests.append(F.col(column) == F.lit(wanted))
    if p.has_html is not None:
        filled = F.coalesce(F.col("body_html_clean"), F.lit("")) != ""
        tests.append(filled if p.has_html else ~filled)
    for column in ("attachment_count", "references_depth", "quoted_line_count"):
        low, high = map(_number, getattr(p, column))
        if low is not None:
            tests.append(F.col(column) >= low)
        if high is not None:
            tests.append(F.col(column) <= high)
    return messages.filter(reduce(lambda a, b: a & b, tests)) if tests else messages


def search_messages(messages: DataFrame, p: SearchParameters) -> DataFrame:
    """The page of results: filtered, ordered, cut at the limit.

    With ``q``, rows (by ``id``) of a rank above 0, which several words give to
    every row (1e-20 at least), with ``rank`` and the headlines of subject and body.
    Without an order, or with an unknown one, the best come first if there is a
    ``q``, else the newest.  Headlines are made for the page alone.
    """
    found = facet_filter(messages, p)
    if p.q:
        ranks = full_text(found, "id", document(F.col("subject_normalized"), F.col("body_clean")), p.q, match="any").filter("rank > 0")
        found = found.drop("rank").join(ranks, "id")
    if "rank" not in found.columns:
        found = found.withColumn("rank", F.lit(None).cast("double"))
    found = found.orderBy(*ORDERINGS.get(p.order, ORDERINGS["-rank" if p.q else "-sent_at"])(p.collation))
    found = found if p.limit is None else found.limit(p.limit)
    if p.q:
        stops = stop_words(messages)
        found = found.withColumns({"headline_subject": headline(F.col("subject_normalized"), p.q, stops), "headline_body": fragments(F.col("body_clean"), p.q, stops)})
    return found


# ---- stems -------------------------------------------------------------------

_VOWEL = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWEL and w[i - 1] in _VOWEL:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-1] not in _VOWEL + "wxY" and w[-2] in _VOWEL and w[-3] not in _VOWEL


def stem(word: str) -> str:
    """English stem by the published Porter2 algorithm."""
    w = word.lower().strip("'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'?$|'$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # 2
    for end, by in (*_STEP2, ("ogi", "og"), ("li", "")):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + by
            break
    # 3
    for end, by in (*_STEP3[:6], ("ative", ""), *_STEP3[6:]):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + by
            break
    # 4
    for end in (*_STEP4[:9], "ion", *_STEP4[9:]):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stem_column(words: Column | str) -> Column:
    """Stems of words; to be used over distinct words."""

    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return F.pandas_udf(stems, "string")(words)


# ---- full text ---------------------------------------------------------------


def stop_words(df: DataFrame) -> list[str]:
    """Spark's own list of English stop words."""
    loaded = df.sparkSession._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")
    return [w for w in loaded if "'" not in w]


def document(subject: Column, body: Column, body_chars: int | None = None) -> Column:
    """Subject and body; of the body the first ``body_chars`` characters if that is given."""
    empty = F.lit("")
    body = body if body_chars is None else F.left(body, F.lit(body_chars))
    return F.concat(F.coalesce(subject, empty), F.lit(" "), F.coalesce(body, empty))


FORMS = 10_000  # words of the wanted stems that are broadcast


def postings(df: DataFrame, key: str, text: Column, stemmed: bool = True, wanted: list[str] | None = None) -> DataFrame:
    """(key, stem, pos): words without stop words, by stem, at their positions.

    Stems are made once for each distinct word and joined back; with ``wanted``,
    only these stems, made of distinct words with the first letter of one.
    """
    words = F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != ""), F.lower)
    tokens = df.select(key, F.posexplode(words).alias("pos", "word"))
    tokens = tokens.withColumn("pos", F.col("pos") + 1).filter(~F.col("word").isin(*stop_words(df)))
    if not stemmed:
        out = tokens.select(key, F.col("word").alias("stem"), "pos")
        return out if wanted is None else out.filter(F.col("stem").isin(*wanted))
    if wanted is not None:
        near = F.left("word", F.lit(1)).isin(*{s[0] for s in wanted})
        forms = tokens.filter(near).select("word").distinct().withColumn("stem", stem_column("word")).filter(F.col("stem").isin(*wanted))
        few = forms.limit(FORMS + 1).collect()
        if len(few) <= FORMS:
            forms = F.broadcast(df.sparkSession.createDataFrame(few, forms.schema))
        return tokens.filter(near).join(forms, "word").select(key, "stem", "pos")
    stems = tokens.select("word").distinct().withColumn("stem", stem_column("word"))
    return tokens.join(stems, "word").select(key, "stem", "pos")


@dataclass
class Query:
    """Alternatives; each needs all its terms. A term is (negated, stems in a row)."""

    alternatives: list[list[tuple[bool, list[str]]]]

    @property
    def stems(self) -> list[str]:
        return list(dict.fromkeys(s for a in self.alternatives for _, term in a for s in term))


def parse_query(text: str, stops: list[str], stemmed: bool = True) -> Query:
    """Web search syntax: words are and-ed, "phrases", or, -not."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if word.lower() == "or" and not sign:
            out.append([])
            continue
        words = [w for w in re.split(r"[^\w]+", (phrase or word).lower()) if w and w not in stops]
        if words:
            out[-1].append((bool(sign), [stem(w) for w in words] if stemmed else words))
    return Query([a for a in out if a])


def _has(term: list[str], at: dict[str, str]) -> Column:
    first = F.col(at[term[0]])
    if len(term) == 1:
        return F.size(first) > 0
    follows = lambda p: reduce(lambda a, b: a & b, (F.array_contains(F.col(at[s]), p + k) for k, s in enumerate(term[1:], 1)))
    return F.exists(first, follows)


# Weight of a word without a label, and the sum of the inverse squares.
_WEIGHT, _SQUARES = 0.1, 1.64493406685


def _rank(query: Query, at: dict[str, str]) -> Column:
    """Sum over occurrences with falling weight, or nearness of pairs if words are and-ed."""
    stems = list(dict.fromkeys(s for a in query.alternatives for negated, term in a if not negated for s in term))
    positions = [F.col(at[s]) for s in stems]
    if len(stems) < 2 or len(query.alternatives) > 1:
        one = [F.aggregate(F.transform(p, lambda _, j: F.lit(_WEIGHT) / ((j + 1) * (j + 1))), F.lit(0.0), lambda a, x: a + x) / _SQUARES for p in positions]
        return reduce(lambda a, b: a + b, one, F.lit(0.0)) / max(len(stems), 1)
    def along(acc: Column, x: Column, others: Column) -> Column:
        return acc * F.aggregate(others, F.lit(1.0), lambda b, y: b * (1 - _WEIGHT * F.sqrt(near(F.when(x == y, 16384).otherwise(F.abs(x - y))))))

    near = lambda d: F.when(d > 100, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    rest = F.lit(1.0)
    for i in range(1, len(positions)):
        for k in range(i):
            others = positions[k]
            rest = rest * F.aggregate(positions[i], F.lit(1.0), lambda a, x: along(a, x, others))  # noqa: B023
    rank = 1 - rest
    return F.when(rank > 0, rank).otherwise(1e-20)


def full_text(df: DataFrame, key: str, text: Column, query: str, stemmed: bool = True, match: str = "boolean") -> DataFrame:
    """(key, rank) of the rows that match.

    ``match``: ``boolean`` keeps rows for which the query holds; ``any`` keeps all
    rows, ranked, as a test on the rank alone would.
    """
    parsed = parse_query(query, stop_words(df), stemmed)
    if not parsed.alternatives:
        return df.select(key, F.lit(0.0).alias("rank")).limit(0)
    at = {s: f"p{i}" for i, s in enumerate(parsed.stems)}
    own = postings(df, key, text, stemmed, list(at)).groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("stem") == s, F.col("pos")))).alias(p) for s, p in at.items()))
    negative = any(all(negated for negated, _ in a) for a in parsed.alternatives)
    if negative or match == "any":
        empty = F.array().cast("array<int>")
        own = df.select(key).join(own, key, "left").withColumns({p: F.coalesce(F.col(p), empty) for p in at.values()})
    return matches(own, key, parsed, at, match)


def matches(own: DataFrame, key: str, parsed: Query, at: dict[str, str], match: str) -> DataFrame:
    """(key, rank) of the rows for which the query holds, or of all; ``at``: the column of each stem's positions."""
    holds = F.lit(False)
    for a in parsed.alternatives:
        holds = holds | reduce(lambda x, y: x & y, (~_has(term, at) if negated else _has(term, at) for negated, term in a))
    out = own if match == "any" else own.filter(holds)
    return out.select(key, _rank(parsed, at).alias("rank"))


START, STOP = "<mark><strong>", "</strong></mark>"


def headline(text: Column, query: str, stops: list[str], start: str = START, stop: str = STOP) -> Column:
    """The text with every word marked whose stem is one of the query's.

    Words are stemmed in Arrow batches, each distinct word once: for pages of results.
    """
    stems = frozenset(s for s in parse_query(query, stops).stems if s)
    if not stems:
        return text
    left = frozenset(stops)

    def marks(texts: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def mark(m: re.Match) -> str:
            word = m.group()
            if (hit := known.get(word)) is None:
                hit = known[word] = word.lower() not in left and stem(word) in stems
            return f"{start}{word}{stop}" if hit else word

        return texts.map(lambda t: None if t is None else re.sub(r"\w+", mark, t))

    return F.pandas_udf(marks, "string")(text)


def fragments(text: Column, query: str, stops: list[str], words: int = 35, most: int = 3) -> Column:
    """Up to ``most`` stretches of about ``words`` words around marked words, joined by ' … '."""
    marked = headline(text, query, stops)
    around = rf"(?s)((?:\S+\s+){{0,{words // 2}}}\S*<mark>.*?</mark>\S*(?:\s+\S+){{0,{words // 2}}})"
    return F.array_join(F.slice(F.regexp_extract_all(marked, F.lit(around), F.lit(1)), 1, most), " … ")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Positions by falling rank, ties by key."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), key)))
