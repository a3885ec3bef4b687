import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import places as P
from tessera.functions import text as X
from tessera.functions import web


def run(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_clean(spark):
    assert run(spark, X.clean_inline, "  a  b\n\tc­d ", "é", None) == ["a b cd", "é", None]
    assert run(spark, X.clean_lines, "  a\t b  \r\n c ­\n") == ["a b\nc"]
    assert run(spark, X.fold, "Olá, MUNDO! Ação_x", "") == ["ola mundo acao_x", ""]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aé \t\n ­.Ç", max_size=30), min_size=1, max_size=20))
def test_inline_against_python(spark, texts):
    want = [re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).replace("­", "")).strip() for t in texts]
    assert run(spark, X.clean_inline, *texts) == want


def test_noise_and_repairs(spark):
    assert run(spark, lambda c: X.drop_noise(c, ["menu_icon"], [r"^\d+/\d+$"]), "a menu_icon b\n1/2\n\n\n\nz \n") == ["a b\n\nz"]
    assert run(spark, lambda c: X.repair(c, {"c a s a": "casa"}), "uma C A S A x") == ["uma casa x"]
    assert run(spark, X.collapse_blank_lines, "\n\na  \n\n\n\nb\n") == ["a\n\nb"]


def test_wrapped_lines(spark):
    join = lambda c: X.join_wrapped(F.split(c, "\n"))
    assert run(spark, join, "mo-\nnumento", "destaca-\nse aqui", "dis-\nse", "Coim-\nBra", "a\nb\n\nc") == ["monumento", "destaca-se aqui", "disse", "Coim- Bra", "a b c"]


def test_headings(spark):
    assert run(spark, X.is_heading, "SÉ VELHA", "Sé Velha", "FIM.", "AB", None) == [True, False, False, False, False]
    assert run(spark, lambda c: X.numbered_heading(c)["title"], "3. SÉ VELHA", "3. Sé velha", "x") == ["SÉ VELHA", None, None]


def test_sentences(spark):
    assert run(spark, X.drop_sentences, "Aberto 9h às 18h. Bonito. \nDas 10h - 12h30", "às 9h apenas.") == ["Bonito.", "às 9h apenas."]
    assert run(spark, lambda c: X.main_text(c), "![i](x)\n\n[a](b) c") == [" \na c"]


def test_language(spark):
    pt, en = "o rio e a casa de um homem que não é", "the house of the man is in the town"
    assert run(spark, X.stopword_language, pt, en, "de the", "") == ["pt", "en", None, None]


def test_prompt_blocks(spark):
    p = "x\n\n[RAG CONTEXT]\na\n\nb\n\n[WEATHER DATA]\n(não utilizado)\n\n[PLACES DATA]\n{}"
    assert run(spark, lambda c: X.block(c, "RAG CONTEXT"), p) == ["a\n\nb"]
    assert run(spark, lambda c: X.block(c, "WEATHER DATA"), p) == [None]
    assert run(spark, lambda c: X.block(c, "PLACES DATA"), p) == ["{}"]
    assert run(spark, X.redact, "key sk-abcdefghijk!") == ["key [REDACTED]!"]


def test_urls(spark):
    urls = ["HTTP://www.X.org", "https://x.org/a?utm_source=1&b=2&c=#f", "http://m.x.org/a/b.html?q=1", " https://x.org/a "]
    assert run(spark, web.canonical, *urls) == ["https://x.org/", "https://x.org/a/?b=2", "https://m.x.org/a/b.html?q=1", "https://x.org/a/"]
    assert run(spark, lambda c: web.is_internal(c, "x.org"), *urls) == [True, True, False, True]
    assert run(spark, web.is_no_fetch, "https://x.org/feed/", "https://x.org/a.PDF", "https://x.org/wp-admin/", "https://x.org/a/") == [True, False, True, False]


def test_first_rule_wins(spark):
    rules = (web.Rule("^/a/", "t1", "c1", "candidate", "r1"), web.Rule("^/", "t2", None, "review", "r2"))
    assert run(spark, lambda c: web.classify(c, rules)["page_type"], "https://x/a/b", "https://x/b", "nothing") == ["t1", "t2", "unknown"]
    got = run(spark, lambda c: web.classify_file(c, F.lit(None).cast("string"))["status"], "https://x/a_FR_1.pdf", "https://x/a_PT_.pdf", "https://x/a.pdf", "https://x/a_fr.pt.pdf")
    assert got == ["irrelevant", "new_candidate", "unknown", "new_candidate"]


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 180.0), (40.2, -8.4, 38.7, -9.1), (38.7, -9.1, 40.2, -8.4)], "a double, b double, c double, d double")
    km = [r[0] for r in df.select(P.haversine_km(*[F.col(c) for c in "abcd"])).collect()]
    assert km[0] == 0 and abs(km[1] - 3.141592653589793 * P.EARTH_KM) < 1e-6 and abs(km[2] - km[3]) < 1e-9 and 170 < km[2] < 180


def test_weather_codes(spark):
    import pytest

    df = spark.createDataFrame([(0,), (99,)], "c int")
    assert [r[0] for r in df.select(P.weather(F.col("c"))).collect()] == ["Céu limpo", "Trovoada com granizo forte"]
    bad = spark.createDataFrame([(4,)], "c int")
    assert bad.select(P.weather(F.col("c"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="unknown weather code"):
        bad.select(P.weather(F.col("c"))).collect()


def test_days_and_forecasts(spark):
    df = spark.sql("SELECT date'2026-10-05' AS d, named_struct('t', array(1.0, 2.0), 'day', array('a', 'b')) AS f, named_struct('t', array(1.0), 'day', array('a', 'b')) AS g")
    today = F.lit("2026-10-04").cast("date")
    row = df.select(P.day_label(F.col("d"), today).alias("l"), P.forecast_rows(F.col("f"), ["t", "day"]).alias("r"), P.forecast_rows(F.col("g"), ["t", "day"]).alias("bad")).first()
    assert row["l"] == "segunda-feira (amanhã)" and [tuple(x) for x in row["r"]] == [(1, "a"), (2, "b")] and row["bad"] is None


def test_country_codes(spark):
    assert run(spark, lambda c: P.country_code(c)["value"], "PT", None, "p1") == ["pt", None, None]


def test_canonical_queries_against_python(spark):
    from urllib.parse import parse_qsl, urlencode

    tracked = re.compile(r"^(utm_\w+|fbclid|gclid|mc_cid|mc_eid|_ga)$", re.IGNORECASE)
    queries = ["a=1&b=", "q=a+b%20c", "utm_source=x&UTM_Medium=y&k=%C3%A9", "x=a%2Fb~c*d_e-f.g", "p=100%&r=%zz", "n", "=v", "a=b=c", "t=%E2%82%AC%26", "é=ü ", "%75tm_id=1&gclid=2&fbclidx=3", "a=1&a=2", "u=%2B+%25"]
    df = spark.createDataFrame([(i, f"HTTP://WWW.Example.ORG/p?{q}#f") for i, q in enumerate(queries)], "i int, u string")
    got = {r["i"]: r["c"] for r in df.select("i", web.canonical(F.col("u")).alias("c")).collect()}
    for i, q in enumerate(queries):
        query = urlencode([(k, v) for k, v in parse_qsl(q) if not tracked.match(k)])
        assert got[i] == "https://example.org/p/" + (f"?{query}" if query else ""), q


def test_each_address_that_is_not_fetched(spark):
    no = [
        "wp-admin", "wp-json/x", "wp-login.php", "wp-content/a", "wp-includes/b", "x/feed", "x/feed/", "?s=1", "a?x=1&p=2", "?replytocom=3",
        *[f"{w}{end}" for w in ("account", "profile", "register", "registration", "password-reset", "lost-password", "sem-acesso") for end in ("", "/")],
        "agentes-e-profissionais/entrar", "agentes-e-profissionais/registo/", "estrela/5", "preco/a", "tipos-de-alojamento/b", "tipo-de-restaurante/c", "ova_framework_hf_el/d",
        "alojamentos/casa", "restaurantes/tasca/", *[f"f.{e}" for e in ("pdf", "jpg", "jpeg", "png", "gif", "webp", "svg", "zip", "doc", "docx", "xls", "xlsx", "mp4")],
    ]
    yes = ["", "feeds/x", "x?sp=1", "accounts", "account/x", "agentes-e-profissionais/", "estrela", "alojamentos/", "alojamentos/a/b", "f.pdfx", "wp-x"]
    df = spark.createDataFrame([(f"https://e.org/{x}", x in no) for x in [*no, *yes]], "u string, want boolean")
    assert [r["u"] for r in df.where(web.is_no_fetch(F.col("u")) != F.col("want")).collect()] == []


def test_lines_end_at_line_feeds_alone(spark):
    wide = " \u00a0\u2003ABC.\u3000"
    assert run(spark, X.stripped, wide, "\tA ", None) == ["ABC.", "\tA", None]
    assert run(spark, X.is_heading, "ABC.\r", "ABC\u2028", "ABC.") == [True, True, False]
    assert run(spark, lambda c: X.numbered_heading(c)["title"], "3. SÉ\rVELHA", "3. 7") == ["SÉ\rVELHA", None]
