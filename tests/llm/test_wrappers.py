import html
import re

from tracewell.llm import wrappers as w

PAGES = "page_id long, url string, html string"


def news(title, paragraphs, extra="", tail=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav><div class=\"ad\">Buy now</div>"
            f"<article><h1>{title}</h1>{body}{extra}</article>{tail}<footer>&copy; site</footer></body></html>")


def accepted(page, wrapper):
    letters = {}

    def letter(key):
        return letters.setdefault(key, chr(0xF0000 + len(letters)))

    expression = re.compile(w.expression(wrapper, letter))
    line = ""
    for kind, value in w.tokens(page):
        if kind == "text":
            if value.strip() and not line.endswith(letter("T")):
                line += letter("T")
        elif kind == "=" or not (w.element_name(value) in w.INLINE and w.element_name(value) != "a"):
            line += letter(kind + value)
    return expression.fullmatch(line) is not None


def text_of(page):
    return w.text_of(page, w.plan_of(w.folded(page), w.words_of(page)))


def test_wrapper_accepts_all_pages_it_was_made_of():
    pages = [news(f"T{k}", [f"p{j} of {k}" for j in range(k)], "<aside>x</aside>" if k % 2 else "", "<div id='comments'><p>c</p></div>" if k % 3 else "") for k in range(8)]
    pages.append(pages[3].replace("</body></html>", ""))
    wrapper = w.folded(pages[0])
    for page in pages[1:]:
        wrapper = w.merged(wrapper, w.folded(page))
    assert all(accepted(p, wrapper) for p in pages)
    assert w.merged(wrapper, w.folded(pages[4])) == wrapper
    assert len(w.shape(wrapper)) < 600


def test_main_text_of_several_layouts():
    assert text_of(news("Ti&amp;tle", ["One  two", "thr<b>e</b>e &lt;4&gt;"])) == "Ti&tle One two three <4>"
    assert text_of(news("T", ["a"], "<aside>side</aside><form>mail <input></form><div class='comments'><p>nice</p></div><section id=\"comment-list\">x</section>")) == "T a"
    assert text_of(news("T", ["a", "b<br>c"], "<ul><li>x</li><li>y</li></ul><script>1</script><!-- no -->")) == "T a b c x y"
    assert text_of("<body><div class='site-header'>Site</div><div id=menu><a href=x>m</a></div><div class=content><p>Real text.<p>More text.</div>"
                   "<div class='cookie-notice'>We use</div></body>") == "Real text. More text."
    assert text_of("<p>plain") == "plain"
    assert text_of("<div class='page has-sidebar'><P>Kept <BR/>text&nbsp;here.</P></div><div role=complementary><p>x</p></div>") == "Kept text here. x"
    assert text_of("<div class=content><p>The story is here.</p></div><aside><article><p>teaser</p></article></aside>") == "The story is here."
    assert text_of("<article></article><div class='ad'>Buy</div><p>stray</p>") == ""
    assert text_of("<article><p>One</p><div class='newsletter-signup'><p>Mail</p></div><p class=ad>Ad</p><p>Two <a href=x>link</a>.</p><table><tr><td>a<td>b</table></article>"
                   "<section id=comments><article class=comment><p>nice</p></article></section>") == "One Two link. a b"
    assert text_of("a < b and <i>c</i>") == "a < b and c"
    assert text_of("<nav><ul><li><a href=/>x</a></ul><main><p>kept</p></main>") == "kept"
    assert text_of("<article><p>own</p></article><aside><article>teaser</article></aside>") == "own"


def test_words_common_to_a_host_are_left_out_of_the_body(spark):
    rows = [(k, "http://h.example/x", f"<body><div><p>Sign for the paper</p></div><div class=c><p>Story {k} of the day</p></div></body>") for k in range(6)]
    got = {r.page_id: r.text for r in w.report(spark.createDataFrame(rows, PAGES)).collect()}
    # One path may hold both; here the layouts differ by class, so only the story's slot varies.
    assert got == {k: f"Story {k} of the day" for k in range(6)}


def test_two_templates_and_ids_of_single_pages_on_one_host(spark):
    """Start tags that exclude each other are no path of any page."""
    rows = [(k, "http://ids.example/x", f"<body><div id=post-{k}><p>Story {k} is told.</p></div></body>") for k in range(1, 4)]
    rows += [(k, "http://two.example/x", f"<body><{tag} class={tag}><p>Story {k} is told.</p></{tag}></body>") for k, tag in enumerate(["div", "section"] * 3, 4)]
    got = {r.page_id: r.text for r in w.report(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: f"Story {k} is told." for k in range(1, 10)}


def test_words_of_single_pages_and_near_copies_stay(spark):
    rows = [(k, "http://h.example/x", f"<body><div><p>Sign here</p></div><div class=c><p>Story {k} of the day</p>{'<blockquote>Only here</blockquote>' if k == 2 else ''}</div></body>")
            for k in range(6)]
    rows += [(k, "http://n.example/x", f"<body><div class=day>{k} May</div><div class=c><p>One long story that all of the pages tell</p></div></body>") for k in range(10, 20)]
    rows += [(k, "http://m.example/x", f"<body><div class=day>{k} May</div><div class=c><p>The story</p></div></body>") for k in (20, 21, 21, 21, 21)]
    got = {r.page_id: r.text for r in w.report(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[k] for k in range(6)] == [f"Story {k} of the day" + (" Only here" if k == 2 else "") for k in range(6)]
    assert [got[k] for k in range(10, 20)] == [f"{k} May One long story that all of the pages tell" for k in range(10, 20)]
    assert got[20] == "20 May The story" and got[21] == "21 May The story"
    changed = (30, "http://h.example/y", "<body><div><p>Closed</p></div><div class=c><p>Story 30 of the day</p></div></body>")
    more = [(k, "http://h.example/x", rows[0][2].replace("Story 0", f"Story {k}")) for k in range(40, 60)]
    got = {r.page_id: r.text for r in w.report(spark.createDataFrame([*rows, *more, changed], PAGES)).collect()}
    assert got[30] == "Closed Story 30 of the day" and got[40] == "Story 40 of the day"


def test_table_equals_the_known_articles(spark):
    rows = []
    for k in range(60):
        url = f"https://{'big' if k % 3 else f'h{k}'}.example.org/{k}" if k % 20 else None
        rows.append((k, url, news(f"T{k}", [f"w{j} &eacute; {k}" for j in range(1 + k % 9)], "<div class=share>tweet</div>" if k % 2 else "")))
    rows += [(60, "http://x.org", None), (61, None, ""), (3, rows[3][1], rows[3][2]), (None, "ftp://a:1/", "<p>q")]
    frame = spark.createDataFrame(rows, PAGES)
    got = w.report(frame).collect()
    assert len(got) == len(rows)
    want = {}
    for page_id, _, page in rows:
        inner = re.search("<article>(.*?)(<div class=share>.*?)?</article>", page or "")
        want[page_id] = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner[1])).split()) if inner else "q" if page_id is None else ""
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    clash = frame.limit(1).withColumn("text", w.F.lit("old")).withColumn("host", w.F.lit(1)).withColumn("wrapper", w.F.lit(2))
    assert set(w.extract(clash).columns) == set(clash.columns)
    assert w.report(spark.createDataFrame([], PAGES)).count() == 0
