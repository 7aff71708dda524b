"""Scalar functions against literal cases and small Python models on generated dirty strings."""

import random
import re

import pytest
from conftest import column
from pyspark.sql import functions as F

from postroom.functions import address, dates, folder, hashing, html, identity, signature, subject, text


def dirty(n, seed=1):
    r = random.Random(seed)
    bits = ["a", "Bc", " ", "  ", "\t", "\n", "\r\n", "\r", "\xa0", "\x0b", "\x1c", "> q", "é", "Re: ", "'", ".", "--", " "]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 14))) for _ in range(n)] + [None, ""]


def test_normalize_text(spark):
    got = column(spark, dirty(200), text.normalize_text)
    assert got == [None if v is None else (re.sub(r"\s+", " ", v.strip()) or None) for v in dirty(200)]


def test_bodies(spark):
    def body(v):
        if v is None:
            return None
        v = v.replace("\r\n", "\n").replace("\r", "\n")
        return "\n".join(x.rstrip() for x in v.split("\n")).strip() or None

    def clean(v):
        v = body(v)
        return v and re.sub(r"\n{3,}", "\n\n", v)

    def quoted(v):
        return sum(x.lstrip().startswith(">") for x in (body(v) or "").splitlines())

    values = dirty(300, 2)
    assert column(spark, values, text.normalize_body) == [body(v) for v in values]
    assert column(spark, values, text.clean_body) == [clean(v) for v in values]
    assert column(spark, values, text.quoted_lines) == [quoted(v) for v in values]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("mailto:<Jane@Corp.COM>", "jane@corp.com"),
        ("'12152'@x.com", "12152@x.com"),
        ("a..b--c@x..org.", "a.b-c@x.org"),
        ("Jane <jane@x.org> and bob@y.org", "jane@x.org"),
        ("a@b@c.org", "b@c.org"),
        ("nobody", None),
        ("   ", None),
        (None, None),
        ("[x@y.org];", "x@y.org"),
    ],
)
def test_addresses(spark, raw, want):
    assert column(spark, [raw], address.normalize_address) == [want]


def test_address_lists_and_ids(spark):
    assert column(spark, ["a@x.org; Bob <B@y.org>, a@x.org", None], address.addresses_in) == [["a@x.org", "b@y.org"], None]
    assert column(spark, [" x <A@B> y", "A@B", None, " "], address.normalize_message_id) == ["<a@b>", "a@b", None, None]
    assert column(spark, ["<A@x>  <b@y> <a@X>", "plain", None], address.references_in) == [["<a@x>", "<b@y>"], ["plain"], []]
    assert column(spark, ["a@x.org", "b@corp.com", None], lambda c: address.is_internal(c, "corp.com")) == [False, True, None]


def test_subjects(spark):
    values = ["Re: FW: re:Hello  There", "fwd : x", "AW: x", "re:", None]
    assert column(spark, values, subject.normalize_subject) == ["hello there", "x", "aw: x", None, None]
    assert column(spark, values, subject.is_reply) == [True, False, False, True, False]
    assert column(spark, values, subject.is_forward) == [False, True, False, False, False]


def test_bodies_that_reply_or_forward(spark):
    reply = ["On Monday X wrote:\nhi", "> quoted", "From: a\nSent: b\nhi", "plain", None]
    assert column(spark, reply, subject.looks_like_reply) == [True, True, True, False, False]
    forward = ["---- Forwarded by X", "From: a\nTo: b\nSubject: c", "From: a\nTo: b\nSent: c", None]
    assert column(spark, forward, subject.looks_like_forward) == [True, True, False, False]


def test_html(spark):
    assert column(spark, ["<p>x", "a < b", "&nbsp;", "<x><y>", None], html.looks_like_html) == [True, False, True, True, False]
    assert column(spark, ["<p>a &amp; b</p><br/>c<script>x</script><!-- y -->", "plain", None], html.html_to_text) == ["a & b\n\nc", "plain", None]
    raw = ["<a href=\"javascript:x()\" onclick='y'>z</a><style>q</style>"]
    assert column(spark, raw, html.sanitize) == ['<a href=\\"#\\">z</a>']
    assert column(spark, raw, lambda c: html.sanitize(c, escaped_quotes=False)) == ['<a href="#">z</a>']


def test_folders(spark):
    names = ["_sent_mail", "Deleted Items", "to_do", "Legal  Work", "misc", None]
    assert column(spark, names, folder.folder_type) == ["sent", "deleted", "tasks", "legal work", "misc", None]
    assert column(spark, names, lambda c: folder.folder_topic(c, folder.folder_type(c))) == [None, None, None, "legal", None, None]
    assert [tuple(r) for r in column(spark, ["1.", "inbox/1.", "a/ferc/2."], folder.occurrence_folder)] == [(".", "", None, None), ("inbox", "inbox", "inbox", None), ("a/ferc", "ferc", "ferc", "regulation")]
    assert column(spark, ["Doe, J!!x_", None], folder.mailbox_key) == ["doe_j_x", None]


def test_identities(spark):
    assert [tuple(r) for r in column(spark, ["Doe, Jane Q", "o'brien-smith", "x"], identity.split_name)] == [("Jane", "Doe"), ("O'Brien-Smith", None), (None, None)]
    assert column(spark, ["jane.doe@x.org", "info@x.org", None], identity.name_from_address) == ["Jane Doe", None, None]
    kinds = column(spark, ["info@x", "x.newsletter@x", "deal.team@x", "jane.doe@x", "jd@x", None], lambda c: identity.identity_type(F.lit(None).cast("string"), c))
    assert kinds == ["system", "external_bulk", "corporate", "likely_person", "unknown", "unknown"]
    assert column(spark, ["Vice President, trader", None], lambda c: identity.titles_in(c)) == [["President", "Vice President", "Trader"], []]
    assert column(spark, ["jdoe", "doej", "jd", "zz", None], lambda c: identity.local_similarity(c, F.lit("jdoe"))) == [1.0, 1.0, 0.85, 0.0, 0.0]


def test_long_runs_of_blanks_take_linear_time(spark):
    import time

    value = "\n".join("a" + " " * 8000 + "b" for _ in range(20)) + " " * 8000
    began = time.time()
    got = column(spark, [value], text.normalize_body)
    assert got == [value.rstrip()] and time.time() - began < 5


def test_signatures(spark):
    values = ["Hi\n\n--\nJane\nTel 5", "Hi all, this is a long sentence that says very much about little.\nBest regards,\nJane", "Hi\nThis message is confidential", "one line", "A long sentence that ends with a stop, and is over sixty characters long.\nAnother long sentence that ends with a stop and is over sixty letters.", None]
    got = [tuple(r) if r else r for r in column(spark, values, signature.split_signature)]
    assert got[0] == ("Hi", "--\nJane\nTel 5")
    # closings of several words are known without blanks, unless asked otherwise
    assert got[1] == (values[1], None)
    spaced = column(spark, values[1:2], lambda c: signature.split_signature(c, closing=signature.SPACED_CLOSING))
    assert tuple(spaced[0]) == (values[1].split("\n")[0], "Best regards,\nJane")
    plain = [values[1].replace("Best r", "R"), values[1].replace("Best regards", "bestregards")]
    assert [r.signature for r in column(spark, plain, signature.split_signature)] == ["Regards,\nJane", "bestregards,\nJane"]
    assert got[2] == ("Hi", "This message is confidential")
    assert got[3] == ("one line", None)
    assert got[4][1] is None


def test_dates(spark):
    values = ["Mon, 14 May 2001 16:39:00 -0700 (PDT)", "1 Jan 2002 00:00 +0000", "3 Feb 2003 04:05:06 -0000", "x", None]
    assert column(spark, values, lambda c: F.date_format(dates.parse_date(c), "yyyy-MM-dd HH:mm:ss")) == ["2001-05-14 23:39:00", "2002-01-01 00:00:00", "2003-02-03 04:05:06", None, None]


def test_hashes_do_not_depend_on_order_or_case(spark):
    def h(people, subj):
        r = F.array(*(F.struct(F.lit("to").alias("recipient_type"), F.lit(p).alias("email")) for p in people))
        files = F.array().cast("array<struct<filename:string,mime_type:string,size_bytes:bigint>>")
        return hashing.canonical_hash(F.lit("A@x.org"), F.lit(None).cast("timestamp"), F.lit(subj), F.lit(None).cast("string"), r, F.array(F.lit("<A@b>")), files)

    row = spark.range(1).select(h(["a@x.org", "b@x.org"], "S  x").alias("a"), h(["b@x.org", "A@x.org"], "s X").alias("b"), h(["b@x.org"], "s x").alias("c")).first()
    assert row.a == row.b != row.c and len(row.a) == 64


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Pear pear apple with apple plum it"), (2, None)], "k int, t string")
    assert [(r.k, r["rank"], r.word, r.n) for r in text.keywords(df, "k", "t", 2).orderBy("k", "rank").collect()] == [(1, 1, "apple", 2), (1, 2, "pear", 2)]


def test_clean_addresses_take_one_pattern(spark):
    """What the pattern takes is what the mending gives; values that need it are left to it."""
    clean = ["a.b@x.org", " Bob <B@Corp.com> ", "<a_1@x-y.org>", "a%+@x.co\n"]
    noisy = ["a..b@x.org", "a_@x.org", "a@-x.org", "mailto:a@x.org", "'a'@x.org", "a@b@c.org d", "none", ""]
    taken = column(spark, clean + noisy, lambda v: F.regexp_extract(v, address.CLEAN, 1) != "")
    assert taken == [True] * len(clean) + [False] * len(noisy)
    assert column(spark, clean + noisy + [None], address.normalize_address) == column(spark, clean + noisy + [None], address._noisy)


def test_trimming_takes_all_blanks(spark):
    blanks = "\t\n\x0b\f\r \x1c\x1f\x85\xa0      　"
    assert column(spark, [f"{blanks}a b{blanks}", blanks, "​a", None], text.strip) == ["a b", "", "​a", None]
    assert column(spark, [f"a{blanks[5:]}\nb \r\n\n c\xa0", " \n"], text.normalize_body) == ["a\nb\n\n c", None]
