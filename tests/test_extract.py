import datetime as dt

from pyspark.sql import functions as F

from equitylake.operators import extract as X
from equitylake.operators import html_scan as H


def row(label, value=None):
    v = f'<span class="t-text -right">{value}</span>' if value is not None else ""
    return f"<tr><td><strong>{label}</strong></td><td>{v}</td></tr>"


PAGE = ("<html><body><table>"
        + row("Prezzo Ultimo Contratto", "9,99")          # older duplicate
        + row("Prezzo Ultimo Contratto", "1.234,56")
        + row("Max Anno", "12,5 - 29/11/24")
        + row("Prezzo di riferimento", "1,2 - 29/11/24 16.07.46")
        + row("Quantit&agrave; Totale", "1.000")
        + row("Fase di mercato", "Chiusura")
        + row("Fase di mercato")                          # last match has no value -> NULL
        + "<tr><td>Lotto Minimo</td><td><span class='t-text -right'>5</span></td></tr>"  # no strong
        + row("Var %&nbsp;", "+1,5%")
        + "<tr><td><table>" + row("Performance 1 Mese", "-2,5") + "</table></td></tr>"
        + row("Numero Contratti", "3.000.000.000")       # beyond INT
        + "</table></body></html>")


def test_detail_rows_python():
    rows = H.detail_rows(PAGE)
    labels = [r[2] for r in rows]
    assert "Lotto Minimo" not in labels
    # nested row visited under the outer and the inner table
    assert sum(1 for r in rows if r[2] == "Performance 1 Mese") == 3
    assert ("Fase di mercato", None) in [(r[2], r[3]) for r in rows]


def test_unclosed_tags_and_entities():
    html = ("<table><tr><td><strong>Super &amp; Sector</strong><td>"
            "<span class='t-text -right'>A &lt;B&gt;<b>x</b>y</span>"
            "<tr><td><strong>Lotto minimo</strong><td><span class='t-text -right'> 7 </span>")
    rows = H.detail_rows(html)
    assert rows[0][2:] == ("Super & Sector", "A <B>")
    assert rows[1][2:] == ("Lotto minimo", " 7 ")


def test_script_inside_a_comment_and_raw_text():
    table = "<table>" + row("Max Oggi", "7") + "</table>"
    assert len(H.detail_rows("<!-- <script> -->" + table + "<script>x</script>")) == 1
    assert H.detail_rows("<script>" + table + "</script>") == []
    assert H.detail_rows("<script>" + table) == []  # unclosed: all of the rest is raw text
    assert len(H.detail_rows("<style>td{}</style >" + table + "<!-- open")) == 1


def labels(html):
    return [(r[2], r[3]) for r in H.detail_rows(html)]


def test_quotes_delimit_values_only_after_an_equals_sign():
    two = row("Max Oggi", "7") + "</table>"
    for tag in ("<tr data-x=don't>", '<tr ">', "<tr a=b'c d=\"e\">", '<tr ="x">', "<tr 'a=\"b\">", '<tr a = "x>y" b=\'"\'>',
                '<tr a=x"y>', '<tr/>', '<tr a="b"c="d">', "<tr\ta='\"'\n>"):
        html = f"<table>{tag}<td><strong>Min Oggi</strong><td><span class='t-text -right'>5</span></tr>" + two
        assert labels(html) == [("Min Oggi", "5"), ("Max Oggi", "7")], tag
    # a value that is never ended takes the rest of the page
    assert labels("<table>" + row("Max Oggi", "7") + '<tr a="b>' + row("Min Oggi", "5").replace('"', "'")) == [("Max Oggi", "7")]
    # two quotes that are not a pair: x has the value q=", k's holds the next tags
    html = '<table><tr x=q="  k="><td><strong>Min Oggi</strong>">' + row("Max Oggi", "7")[4:] + "</table>"
    assert labels(html) == [("Max Oggi", "7")]


def test_comments_end_as_in_html5():
    table = "<table>" + row("Max Oggi", "7") + "</table>"
    for comment in ("<!-- a --!>", "<!-->", "<!--->", "<!-- a -- b -->", "<!---->", "<!a>", "<?x>", "</ x>", "<!doctype html>"):
        assert labels(comment + table) == [("Max Oggi", "7")], comment
    assert labels("<table><tr><td><strong>Max </>Oggi<!-- c --> x</strong></table>") == [("Max Oggi x", None)]
    assert labels("<!-- " + table) == []


def test_text_elements():
    inner = "<strong>no</strong>"
    for tag in ("textarea", "title", "style", "script", "noscript", "iframe", "xmp"):
        assert labels(f"<table><tr><td><{tag}>{inner}</{tag} ><strong>Max Oggi</strong></table>") == [("Max Oggi", None)]
    assert labels("<table><tr><td><strong>a<textarea>\n&lt;b>&amp;</textarea></strong></table>") == [("a<b>&", None)]
    assert labels("<table><tr><td><script><!-- <script>x</script> --></script><strong>a</strong></table>") == [("a", None)]
    assert labels("<table><tr><td><plaintext>" + inner) == []
    assert labels("<table><tr><td><strong>a &lt; b < c\r\nd</strong></table>") == [("a < b < c\nd", None)]


def test_hostile_pages_take_linear_time():
    import time
    for html in ('<a "' * 250_000, "<a b='" * 150_000, '<a b="' * 150_000 + ">", "<div>" * 8000 + "</div>" * 8000,
                 "<div>" * 8000 + "</b>" * 8000, "<div><table>" + "<span>" * 20_000 + "</div>" * 20_000,
                 "<table><p><tr><td>" + "<b>" * 20_000 + "<div></div>" * 10_000, "<!--" * 250_000, "<script>" * 100_000,
                 "</" * 300_000, "<title>" * 100_000, "<table><tr><td><span class='t-text -right'>" * 5000):
        start = time.process_time()
        assert len(H.properties_of(H._one(html), ("x",))) == 1 and H.links(html) == []
        assert time.process_time() - start < 3, html[:40]


def test_batches_of_pages_equal_single_pages():
    import random

    import pyarrow as pa
    rng = random.Random(4)
    bits = ["<table>", "<tr>", "<td>", "</td>", "</tr>", "</table>", "<strong>", "</strong>", "<span class='t-text -right'>",
            '<span class="t-text -right" x=1>', "</span>", "a", "&amp;", "<", ">", '"', "'", "=", "<!--", "-->", "<p ", "/>",
            "<script>", "</script>", "<blockquote>", "</fieldset>", "<Section/", "<B", " x=y", ' a="', "è", "<div>", "</div>", "<a class='u-hidden -xs' href=h>"]
    pages = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", PAGE, LISTING]
    both = pa.array(["skipped", *pages]).slice(1)
    every = H.Pages(both)
    for fast, html in zip(H.detail_rows_of(every), pages):
        assert fast == H.detail_rows(html or "")
    # plain tag ends are the ends that the tag pattern finds
    for i, html in enumerate(pages):
        data, starts, ends, tags, names = every.page(i)
        assert data == (html or "").encode()
        for lt, end, tag in zip(starts, ends, tags):
            m = H._NAME.match(data, lt + 1 + data.startswith(b"/", lt + 1))
            name = m and m[0].lower().decode()
            assert (tag >= 0) == (m is not None and len(name) <= 8)
            assert tag < 0 or (names[tag >> 1], tag & 1) == (name, data[lt + 1:lt + 2] == b"/")
            if end >= 0 and m:
                assert H._REST.match(data, m.end()).end() == end, data[lt:lt + 80]
    assert H.links_of(both) == [H.links(html or "") for html in pages]


def test_equal_bodies_are_scanned_once(monkeypatch):
    import time

    import pyarrow as pa
    bodies = [f"<table>{row('Max Oggi', k) * 300}</table>" for k in range(60)]
    took = {}
    for name, pages in (("equal", [b for b in bodies for _ in range(4)]), ("own", [f"{b}<!--{k}-->" for b in bodies for k in range(4)])):
        monkeypatch.setattr(H, "_repeated", H.Repeated())
        start = time.process_time()
        got = [x for k in range(0, 240, 40) for x in H.properties_of(pa.array(pages[k:k + 40]), X._TERMS)]
        took[name] = time.process_time() - start
        assert H._repeated.scanned == (60 if name == "equal" else 240)
        assert [g[X._TERMS.index("max oggi")] for g in got] == [str(k) for k in range(60) for _ in range(4)]
    assert took["equal"] < 0.5 * took["own"]
    # links and properties of one body are kept apart, and so are other terms
    monkeypatch.setattr(H, "_repeated", H.Repeated(100, 50))
    for _ in range(2):
        assert H.properties_of(H._one(LISTING), ("x",))[0] == [None]
        assert H.properties_of(H._one(LISTING), ("x", "y"))[0] == [None, None]
        assert len(H.links(LISTING)) == 5 and H.links(LISTING, H.NAV_LINKS, None) == []
    many = pa.array([f"<table>{row('Max Oggi', k)}</table>" for k in range(200)])
    assert len(H.properties_of(many, ("max oggi",))) == 200 and H._repeated.values <= 50


def test_properties_are_the_last_matches():
    import random
    rng = random.Random(9)
    terms = ("max anno", "min", "anno", "oggi")
    for _ in range(200):
        def table(depth):
            return "<table>" + "".join(
                "<tr><td><strong>" + rng.choice(["Max Anno", "MIN oggi", "Anno", "x", "oggi min"]) + "</strong>"
                + (f"<span class='t-text -right'>{rng.randint(0, 99)}</span>" if rng.random() < 0.7 else "")
                + (table(depth + 1) if rng.random() < 0.3 and depth < 3 else "") + "</td></tr>"
                for _ in range(rng.randint(1, 4))) + "</table>"
        html = table(0) + table(0)
        expected = [None] * len(terms)
        for _, _, label, value in H.detail_rows(html):
            for k, t in enumerate(terms):
                if t in label.lower():
                    expected[k] = value
        assert H.properties_of(H._one(html), terms)[0] == expected


def test_scan_is_linear_in_the_page():
    import time

    def took(n):
        html = "<table>" + row("Max Oggi", "7") * n + "</table>"
        start = time.process_time()
        assert len(H.detail_rows(html)) == n
        return time.process_time() - start
    small = took(10_000)
    assert took(100_000) < 30 * small + 1


def _pages(spark, *htmls):
    return spark.createDataFrame([(i + 1, f"u{i}", h) for i, h in enumerate(htmls)],
                                 "page_id bigint, url string, html string")


def test_assign_and_type(spark):
    pages = _pages(spark, PAGE, "<p>no tables</p>", "")
    props = X.scan_properties(pages)
    empties = {r.page_id: r.empty_page for r in props.collect()}
    assert empties == {1: False, 2: False, 3: True}  # every page has a row
    raw = (props.drop("url")
           .withColumn("updated_at", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
           .withColumn("isin", F.lit("IT0001233417")))
    wide = {r.page_id: r for r in X.typed_wide(raw, keep=("isin", "page_id")).collect()}
    r = wide[1]
    assert r.prezzo_ultimo_contratto == 1234.56          # last of the duplicates
    assert (r.max_anno, r.max_anno_date) == (12.5, dt.date(2024, 11, 29))
    assert (r.prezzo_riferimento, r.data_ora_prezzo_rifermento) == (1.2, dt.datetime(2024, 11, 29, 16, 7, 46))
    assert r.quantita_totale == 1000.0
    assert r.fase_di_mercato is None                     # last match without value
    assert r.lotto_minimo is None                        # row without strong ignored
    assert r.var_percentuale == 1.5                      # NBSP in label, contains "var %"
    assert r.performance_1_mese == -2.5                  # from the nested table
    assert r.numero_contratti is None and r._numero_contratti_overflow is True
    assert r.id_strumento is None
    # a fetched page without any labelled row still yields an all-NULL record
    assert wide[2].prezzo_ultimo_contratto is None and wide[2].isin == "IT0001233417"


def test_one_row_two_properties(spark):
    # a label containing two terms feeds both properties
    pages = _pages(spark, "<table>" + row("Max Oggi / Min Oggi", "7") + "</table>")
    p = X.scan_properties(pages).collect()[0]
    assert p.max_oggi == "7" and p.min_oggi == "7"


LISTING = ('<div data-bb-view="list-aZ-stream"><table class="m-table -firstlevel"><tr><td>'
           '<a class="u-hidden -xs" href="/borsa/azioni/scheda/IT0001233417.html?lang=it">'
           '<span class="t-text">A2A</span></a>'
           '<a class="u-hidden -xs"><span class="t-text">NoHref</span></a>'
           '<a class="u-hidden -xs" href="/s/IT0001233417.html"></a>'
           '<a class="u-hidden -xs" href="/s/IT000123341.html"><span class="t-text">Short</span></a>'
           '<a class="u-hidden -xs" href="/s/IT000123341X.html"><span class="t-text">Letter</span></a>'
           '</td></tr></table></div>'
           '<a class="u-hidden -xs" href="/s/IT0009999991.html"><span class="t-text">Outside</span></a>')


def test_listing_links(spark):
    from equitylake.plans.jobs import extract_instruments
    pages = _pages(spark, LISTING, LISTING, "")
    inst, outcome, metrics = extract_instruments(pages, dt.datetime(2024, 1, 1))
    errs = sorted((r.link_ord, r.error) for r in outcome.where("page_id = 1").collect())
    assert errs == [(0, None), (1, "invalid_page"), (2, "invalid_page"),
                    (3, "parsing_error"), (4, "parsing_error")]
    got = inst.collect()
    assert [(r.isin, r.share_name) for r in got] == [("IT0001233417", "A2A")]
    m = metrics.collect()[0].asDict()
    # counted before de-duplication; the empty page adds an error, not a total
    assert m["total"] == 10 and m["successful"] == 2
    assert m["invalid_page"] == 5 and m["parsing_error"] == 4


def test_scanner_leniency():
    html = ("<TABLE><TBODY><TR><TD><STRONG>Max <!-- x -->Oggi</STRONG>"
            "<TD><SPAN CLASS=t-text -right class='ignored'>5<br>6</SPAN>"
            "<tr><td><strong>Min Oggi</strong><script>var s='</td><td><strong>Bad</strong>';</script>"
            "<td><span class=\"x t-text -right y\">&#55;,5</span></td></tr></tbody></table>")
    rows = H.detail_rows(html)
    labels = [r[2] for r in rows]
    assert labels == ["Max Oggi", "Min Oggi"]          # comment splits text, label joins it
    assert rows[1][3] == "7,5"                         # numeric entity, classes in any order
    # an unquoted class value ends at the blank (and the first of two class
    # attributes wins): the first span lacks -right, so that row has no value
    assert rows[0][3] is None


def test_first_text_node_stops_at_tag():
    rows = H.detail_rows('<table><tr><td><strong>Max Anno</strong></td>'
                         '<td><span class="t-text -right">12,5<br> - 29/11/24</span></td></tr></table>')
    assert rows[0][3] == "12,5"
