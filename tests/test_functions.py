"""Facts about the text functions, parsers and measures."""

import pytest
from pyspark.sql import functions as F

from lithic.functions import normalize as nm
from lithic.functions import similarity as sim
from lithic.functions import text as tx


def answers(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_dates(spark):
    good = {
        "08/15/2025": "2025-08-15", "15-Aug-2025": "2025-08-15", "2025.08.15": "2025-08-15", "2025-08-15": "2025-08-15", "January 5, 2024": "2024-01-05", "5 january 2024": "2024-01-05",
        "2025-08-15T10:00:00Z": "2025-08-15", "2025-08-15T23:30:00-08:00": "2025-08-15", "2025-08-15 10:00": "2025-08-15", "15.08.2025": "2025-08-15", "25/12/2024": "2024-12-25",
        "Friday, August 15th, 2025": "2025-08-15", "Sept 3, 2024": "2024-09-03", "AUG 15 2025 10:30 PM": "2025-08-15", "2025-08-15T10:00:00.123+02:00": "2025-08-15", " 2025/8/5 ": "2025-08-05",
        "5 Mar 24": "2024-03-05", "1/2/24": "2024-01-02", "Mar 5 '69": "1969-03-05", "31/1/68": "2068-01-31", "24 Mar 05": "2005-03-24", "2024 March 5": "2024-03-05", "March 2024 5": "2024-03-05", "5th of March, 2024": "2024-03-05",
        "20240305": "2024-03-05", "2024-13-02": "2024-02-13", "05.03.2024": "2024-03-05", "3.4.24": "2024-04-03", "Tue 5 Mar 2024 at 5pm": "2024-03-05", "5 mars 2024": "2024-03-05", "5. März 2024": "2024-03-05", "1er août 2023": "2023-08-01", "5 de marzo de 2024": "2024-03-05",
        "29 Feb 2024": "2024-02-29", "2024-03-05 10:00:00,5 GMT": "2024-03-05", "March 5 , 2024": "2024-03-05",
    }
    got = answers(spark, list(good), nm.parse_date)
    assert {k: (r["value"], r["ok"]) for k, r in zip(good, got, strict=True)} == {k: (v, True) for k, v in good.items()}
    bad = ["yesterday", "in two days", "2025-13-45", "", "15", "hello 2025", "March 2024", "29 Feb 2023", "5 Mar 2024 x", "1/2", "1/2/3/4", "123/4/2024", "5 Mar May 2024", "2024-03", "1/2/245", "10:30", "$5/6/2024", "5 2024 Mar 3", None]
    assert [(r["value"], r["ok"]) for r in answers(spark, bad, nm.parse_date)] == [(b, False) for b in bad]


def test_phones(spark):
    values = ["+14155550123", "+1 (415) 555-0123", "+10000000000", "+999999999999", "+442071838750", "+4930123456", "+35312345678", "+2105551234", "415-555-0123", "+1415555012", "x", None]
    assert [r["ok"] for r in answers(spark, values, nm.parse_phone)] == [True, True, False, False, True, True, True, False, False, False, False, False]
    plans = {"+4900000000000": False, "+49 (0)30 123456": True, "+44 020 7183 8750": True, "+33 6 12 34 56 78": True, "+33 6 12 34 56 7": False, "+33 06 12 34 56 78": True, "+39 06 698 12345": True, "+86 138 0013 8000": True, "+81 3-1234-5678": True, "+91 98765 43210": True, "+55 11 91234-5678": True, "+55 11 1234-5678": False, "+61 2 9374 4000": True, "+34 612 34 56 78": True, "+34 412 34 56 78": False, "+7 495 123-45-67": True, "+354 412 3456": True, "+999 123456": False, "+1 555": False, "+14155550123 x5": False, "+674 555 1234": True}
    assert dict(zip(plans, [r["ok"] for r in answers(spark, list(plans), nm.parse_phone)], strict=True)) == plans
    assert [r["value"] for r in answers(spark, ["+49 (0)30 123456", "+44 020 7183 8750", "030 123456"], lambda v: nm.parse_phone(v, "DE"))] == ["+4930123456", "+442071838750", "+4930123456"]
    assert [r["value"] for r in answers(spark, ["415-555-0123", "1 415 555 0123", "015-555-0123"], lambda v: nm.parse_phone(v, "US"))] == ["+14155550123", "+14155550123", "015-555-0123"]


def test_rules(spark):
    assert answers(spark, ["Žluťoučký Straße", "Москва Ельцин", "Αθήνα", "北京", "Łódź"], nm.nfkd_fold) == ["Zlutoucky Strasse", "Moskva Eltsin", "Athena", "北京", "Lodz"]
    addresses = ["12 N. Main St.", "St. Mary Ave", "5 e 3rd st apt 4", "100 E Oak Blvd, Ste 5", "west st", "Sten Ct", "", None]
    assert answers(spark, addresses, nm.expand_address_abbrev) == ["12 North Main Street", "Saint Mary Avenue", "5 e 3rd Street Apartment 4", "100 East Oak Boulevard, Suite 5", "west Street", "Sten Court", "", None]
    names = ["Acme, Inc.", "Acme Co., Ltd.", "Inc", "Limited Brands", "Acme  Holdings", "Foo S.A.", "", None]
    assert answers(spark, names, nm.strip_corporate_suffix) == ["Acme", "Acme", "Inc", "Limited Brands", "Acme  Holdings", "Foo", "", None]
    assert answers(spark, ["a,b;c", "x_y*z", "(q)"], nm.strip_punctuation) == ["a b c", "x y z", " q "]
    assert answers(spark, ["STRASSE ß", "ﬁne", "ΣΊΣΥΦΟΣ"], nm.case_fold) == ["strasse ss", "fine", "σίσυφοσ"]


def test_addresses(spark):
    closed = [
        "http://[::ffff:127.0.0.1]/", "http://[::ffff:10.0.0.1]", "http://[0:0:0:0:0:0:0:1]", "http://localhost./x", "http://0177.0.0.1", "http://127.1", "http://0x7f000001", "http://2130706433", "http://10.0.0.1",
        "http://172.20.3.4", "http://100.64.0.1", "http://169.254.169.254/meta", "http://224.0.0.1", "http://[fe80::1%25eth0]", "http://[fc00::1]", "http://[2002:7f00:1::]", "http://[2001:db8::1]", "http://a.local", "ftp://a.b", "http://", "http://999.1.1.1", "x", None,
        "http://user@127.0.0.1/", "http://metadata.internal/", "http://1.2.3.4.5", "http://a@b@127.0.0.1/", "http://a@b@example.org/", "http://１２７.0.0.1/", "http://localhost。/", "http://127。0。0。1/", "http://ｌｏｃａｌｈｏｓｔ:80/",
        "http://example.org\\@127.0.0.1/", "http://127.0.0.1\\.example.org", "http://exa mple.org/", "http://%31%32%37.0.0.1", "http://١٢٧.0.0.1", "http://①②⑦.0.0.1", "http://example.org／x", "http://:80/", "http://@/",
    ]
    assert answers(spark, closed, tx.safe_url) == [False] * len(closed)
    opened = ["http://example.com", "HTTPS://Example.COM./p?q#f", "http://8.8.8.8:80/", "http://[2a00:1450:4001:81b::200e]/", "http://u:p@example.com/", "http://user@8.8.8.8/a@b@c", "http://ｅｘａｍｐｌｅ．ｃｏｍ/", "http://bücher.example:8080?q=@", "http://10.example.com", "http://1e100.net"]
    assert answers(spark, opened, tx.safe_url) == [True] * len(opened)


def test_texts(spark):
    pages = ["<p>One &amp; <b>two</b></p><script>x<y</script><div>three<br/>four</div><!-- no -->", "plain", "", None]
    assert answers(spark, pages, tx.html_text) == ["One & two\nthree\nfour", "plain", "", None]
    marked = {
        "a < b and c > d": "a < b and c > d", "&#8217;&eacute;&#x41;&#146;&unknown;&amp;lt; &ampx &copy;2024 &#0;&#55296;&#xFFFFFF;": "’éA’&unknown;&lt; &ampx ©2024 ���",
        '<a title="x > y" href=\'p>q\'>link</a> 1<2': "link 1<2", "kept<script>var a = '<p>';": "kept", "kept<!-- open <b>no</b>": "kept", "<style a='>'>p{}</style>x": "x",
        "<p>one<p>two</p></P\n>three<hr/>": "one\ntwo\nthree", "<!DOCTYPE html><?x y?>t</ b>": "t</ b>", "cut <a href='x": "cut", 'cut <a title="x>text': "cut", "x &lt;b&gt; y": "x <b> y", "AT&T; R&D &": "AT&T; R&D &", "<3 <- <=>": "<3 <- <=>",
    }
    assert dict(zip(marked, answers(spark, list(marked), tx.html_text), strict=True)) == marked
    assert answers(spark, ["R&amp<b>D</b> &amp; &#65 &#65; &lt"], lambda c: tx.html_text(c, closed=True)) == ["R&ampD & &#65 A &lt"]
    long = "<p title='" + "x>" * 50_000 + "'>end</p>" + "<b>" * 50_000 + "&amp;" * 20_000
    assert answers(spark, [long], tx.html_text) == ["end\n" + "&" * 20_000]
    assert tx.strip_codefence("```json\n{}\n```") == "{}" and tx.strip_codefence("a ``` b") == "a ``` b" and tx.strip_codefence("``` x ```") == "x"
    assert answers(spark, ["event: a\ndata: {\"x\":1}\n\ndata: one\ndata: two\n\n: ping\n\n"], tx.sse_frames)[0] == [("a", '{"x":1}'), ("message", "one\ntwo")]
    assert answers(spark, ['[{"type":"thinking","thinking":"so"},{"type":"text"},{"type":"thinking","thinking":" then "}]', "bad", None], tx.thinking_text) == ["so\n\nthen", "", ""]
    assert answers(spark, ['[{"title":"T","url":"u"},{"title":"no"},{"url":"v"}]', "bad"], tx.search_summary) == ["- T (u)\n- v (v)", ""]


def test_measures(spark):
    assert sim.registry(spark).count() == len(sim.REGISTRY) == len(sim.ABOUT) and {r["name"] for r in sim.registry(spark, "date").collect()} == {"exact", "date_proximity"}
    with pytest.raises(ValueError):
        sim.similarity("nope", F.lit("a"), F.lit("b"))
    assert answers(spark, ["0.5", "-1", "7", "NaN", None], lambda v: sim.clamped(v.cast("double"))) == [0.5, 0, 1, 0, 0]
