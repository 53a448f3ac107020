import html
import re

from pyspark.sql import functions as F

from sharpfleet.llm.extract import extract, main_text

from .common import given

STOPS = "and this is what the article has to say about the thing that it is for, as it was and will be with all of it "


def test_articles_of_the_given_pages(spark):
    """The pages hold one article each: its blocks, found by plain patterns, are the text."""
    rows = extract(given(spark, "pages").withColumn("page", F.col("html"))).select("page", "text").collect()
    assert rows
    for page, text in rows:
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:p|h1)>", article))
        assert text == "\n\n".join(p for p in parts if p)


def test_two_passes_without_an_article_element():
    page = f"""<body><div class="menu"><a href=/>Home</a> <a href=/b>News</a></div><div><h2>Title</h2><p>{STOPS * 3}</p><p>Short one.</p>
      <div class="ad">{STOPS * 3}</div><p>{STOPS * 3}<p>Tail &amp; end&#33;</div><div id="comments"><p>{STOPS * 3}</p></div>
      <form>Name <input></form><div style="display: none">{STOPS * 3}</div><!-- {STOPS} --><footer>{STOPS * 3}</footer><script>x = "<p>{STOPS}</p>"</script></body>"""
    assert main_text(page) == "\n\n".join(["Title", (STOPS * 3).strip(), "Short one.", (STOPS * 3).strip(), "Tail & end!"])


def test_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<p></p><div>") == main_text("<!-- open") == main_text("<script>var a = '<p>") == ""
    assert main_text("a &lt; b") == "a < b" and main_text("<article><p>x<p>y<br>z<br><br>w</article>") == "x\n\ny z\n\nw"
    assert main_text("<article><p>" + "word " * 100_000 + "</article>") == ("word " * 100_000).strip()
    assert main_text("<p class='\"><b>" * 2000) == ""
    assert main_text("<article><p>Kept.</p><div class=comment-list><article><p>" + STOPS * 4 + "</p></article></div></article>") == "Kept."
    pages = spark.createDataFrame([(None, None, None, "old")], "page_id long, url string, html string, text string")
    assert extract(pages).collect()[0]["text"] == "" and extract(pages.limit(0)).count() == 0


def test_elements_that_do_not_end_keep_the_rest_of_the_page():
    for tag in ("<video-js id=x></video-js>", "<svg-icon>", "<select-box>", "<svg class=i />", "<iframe src='/a'/>", "<object/>", "<math/>", "<svg>", "<video src=a>", "<canvas", "<VIDEO/>"):
        page = f"<article><p>Before.</p>{tag}{'>' if tag == '<canvas' else ''}<p>After.</p></article>"
        assert main_text(page) == "Before.\n\nAfter.", tag
    for tag in ("<svg class='/>'><text>no</text></svg>", "<select a=1><option>no</select >", "<script>'<p>no'</script>", "<style/>no</style>", "<object><p>no</p></OBJECT>", "<svg/><svg>no</svg>", "<title a='>'>no</title>"):
        assert main_text(f"<article><p>Before.</p>{tag}<p>After.</p></article>") == "Before.\n\nAfter.", tag
    for name in ("script", "style", "textarea", "title"):
        assert main_text(f"<article><p>Before.</p><{name} x><p>After.</p></article>") == "Before."
    assert main_text("<article><p>Before.</p>" + "<video>" * 20_000 + "<p>After.</p></article>") == "Before.\n\nAfter."


def test_the_article_element_is_one_vote_of_several(spark):
    """At least 95 of 100 pages keep their text without the element; so do long paragraphs between unnamed lists of links."""
    rows = [r["html"] for r in given(spark, "pages").select("html").collect()]
    renamed = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in rows]
    assert sum(main_text(a) == main_text(b) for a, b in zip(rows, renamed)) >= 0.95 * len(rows)
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Some page of the site</a></li>" for i in range(6)) + "</ul></div>"
    page = f"<body>{links}<div><h1>Title</h1><p>Short.</p><p>{STOPS * 3}</p><p><a href=/x>One link</a></p></div>{links}</body>"
    want = "\n\n".join(["Title", "Short.", (STOPS * 3).strip(), "One link"])
    assert main_text(page) == want.removesuffix("\n\nOne link")  # here the density of links decides, in an article its vote is outweighed
    assert main_text(page.replace("<div><h1>", "<article><h1>").replace("link</a></p></div>", "link</a></p></article>")) == want
    assert main_text(f"<article><p>{STOPS * 3}</p></article><div><p>Short words outside.</p></div>") == (STOPS * 3).strip()


def test_scripts_without_the_stop_words():
    russian, chinese = "Это длинный текст о разных вещах, который занимает много места на странице и не кончается. " * 3, "这是一篇很长的文章。" * 30
    assert main_text(f"<div class=nav>Меню</div><div><p>{russian}</p><p>{chinese}</p></div>") == f"{russian.strip()}\n\n{chinese}"


def test_names_count_whole():
    for attrs in ("class=related-work", "id=search-methods", "data-hidden", "data-class=ad", "class=legal-history", "class=header-text", "class='entry-header'"):
        kept = attrs not in ("class=header-text",)
        assert (main_text(f"<article><section {attrs}><p>Kept.</p></section><p>{STOPS * 3}</p></article>").startswith("Kept.")) == kept, attrs
    for attrs in ("class=related-posts", "class=search-box", "id=cookie-banner", "class=siteFooter", "class='x ad-slot'", "hidden", "style='display: none'", "aria-hidden=true", "class=legal"):
        assert main_text(f"<article><section {attrs}><p>{STOPS * 3}</p></section><p>Kept.</p></article>") == "Kept.", attrs


def test_elements_inside_a_line():
    assert main_text("<article><p>a<span hidden>no <span>no</span> no</span>b <button>no</button>c<label>no<br>no</label> <i class=ad>no</i>d</p></article>") == "ab c d"
    assert main_text("<article><div><span hidden>open</div><p>a</p><button>open<p>b</p></article>") == "a\n\nb"
    assert main_text("<article><p>a <span data-hidden class=word>b</span><br hidden>c</p></article>") == "a b c"
