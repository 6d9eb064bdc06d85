"""Main text: everyday pages, ends of scripts and comments, and messages against enumeration."""

import itertools
import random

import pytest

from ledgerloom.llm import htmltext

TITLE, FIRST, SECOND = "Title of the piece", "the lake and the stone moved under the bright river sun and over walls", "news of the old garden walks in small light under trees of the city"
PIECES = {
    "nothing": "", "button": "<button>Play</button>", "buttons": "<button>Share</button>" * 8, "rules": "<hr><hr><hr>", "scripts": "<script>x</script>" * 3, "script end": "<script>var a=1</script foo>", "comment end": "<!-- x --!>", "empty comment": "<!-->",
    "link": '<p><a href="/x">read the other story here</a></p>', "links": '<p><a href="/x">read the other story here</a></p>' * 3, "link list": "<ul><li><a href=1>one thing</a></li><li><a href=2>two things</a></li></ul>",
    "figure": "<figure><img src=a><figcaption>A view</figcaption></figure>", "figures": "<figure><img src=a></figure>" * 4, "details": "<details><summary>More</summary><p>inner words here now</p></details>", "forms": "<form><input><button>Go</button></form>" * 3,
    "frame": "<iframe src=x></iframe>", "video": "<video controls><source src=x></video>", "style": "<style>p{}</style>" * 2, "drawing": "<svg><path d=1></path></svg>", "empty": "<div></div><p></p><span></span>", "select": "<select><option>a<option>b</select>", "noscript": "<noscript>enable it</noscript>", "headings": "<h2>Part</h2>" * 3,
}


@pytest.fixture(scope="module")
def model():
    return htmltext.train(htmltext.labelled_pages())


@pytest.mark.parametrize("name", PIECES)
@pytest.mark.parametrize("outer", ["article", "main", "div class='content'"])
def test_articles_keep_their_text(model, name, outer):
    tag = outer.split()[0]
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul></nav><{outer}><h1>{TITLE}</h1><p>{FIRST}</p>{PIECES[name]}<p>{SECOND}</p></{tag}><footer>Copyright words</footer></body></html>"
    blocks = htmltext.main_text(model, page).split("\n")
    assert blocks[:2] == [TITLE, FIRST] and blocks[-1] == SECOND


def test_marginals_equal_enumeration(model):
    rng = random.Random(1)
    for _ in range(60):
        nodes = [htmltext.Node("#root", -1)]
        for i in range(rng.randint(1, 7)):
            nodes.append(htmltext.Node(rng.choice("div p li a button article nav section".split()), rng.randrange(len(nodes)), frozenset(rng.choice([[], [], ["menu"], ["content"], ["unseen"]])), rng.choice([0, 1, 8, 30]), rng.choice([0, 0, 1])))
        told, total, found = model.potentials(nodes), 0.0, [0.0] * len(nodes)
        for labels in itertools.product(htmltext.STATES, repeat=len(nodes) - 1):
            labels = (htmltext.WRAPPER, *labels)
            p = 1.0
            for i, node in enumerate(nodes):
                p *= told[i][labels[i]] * (model.edge[htmltext.kind(node)][labels[node.parent]][labels[i]] if i else 1)
            total += p
            for i, y in enumerate(labels):
                found[i] += p * (y == htmltext.CONTENT)
        assert model.marginals(nodes) == pytest.approx([x / total for x in found], abs=1e-9)


def test_nodes_alike_count_less(model):
    page = "<article>" + "<button>x</button>" * 50 + "</article>"
    one, many = htmltext.parse("<article><button>x</button></article>")[0], htmltext.parse(page)[0]
    lone, each = model.potentials(one)[2], model.potentials(many)[2]
    assert max(each) / min(each) == pytest.approx((max(lone) / min(lone)) ** ((1 + htmltext.math.log(50)) / 50), rel=1e-6)


def test_repeated_rows_agree_and_odd_pages(spark):
    page = f"<article><h1>{TITLE}</h1><p>{FIRST}</p></article>"
    rows = [(1, page), (1, page), (None, page), (2, None), (3, ""), (4, "<"), (5, "<!--"), (6, "<script>"), (7, "a" * 200_000)]
    table = spark.createDataFrame([(i, h, "clash", "clash") for i, h in rows], "page_id long, html string, text string, n_chars string")
    got = [(r.page_id, r.text) for r in htmltext.extract_pages(table).collect()]
    assert sum(t == f"{TITLE}\n{FIRST}" for _, t in got) == 3 and all(t is not None for _, t in got) and len(got) == len(rows)
    assert all(t == "" for i, t in got if i in (2, 3, 5, 6))
