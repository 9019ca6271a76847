import time

import pytest

from tessera.llm import markup as M
from tests.llm.conftest import clashing, pseudo_words

PAGE = "page_id bigint, title string, source_file string, content string"


@pytest.mark.parametrize(
    "text,want",
    [
        ("<p>а", "html"), ("а<br/>б", "html"), ("а &nbsp; б", "html"), ("<!-- x", "html"), ("&#x201E;", "html"), ("а<ref>x</ref>", "wiki"), ("[[а|б", "wiki"), ("{{x", "wiki"), ("'''а''' е", "wiki"), ("{| x\n|}", "wiki"), ("[https://a.b в]", "wiki"),
        ("# Дом\nx", "markdown"), ("а **б** в", "markdown"), ("[а](https://b)", "markdown"), ("![а](b.png)", "markdown"), ("`код` x", "markdown"), ("```x", "markdown"), ("| а |\n|---|\n", "markdown"), ("[1]: https://a.b", "markdown"), ("~~а~~", "markdown"), ("[а][1]", "markdown"), ("[[а]] [https://b.c д]", "wiki"), ("__а__", "markdown"),
        ("\\section{а}", "latex"), ("а $x_1^2$ б", "latex"), ("$$Q", "latex"), ("\\(x\\)", "latex"), ("\\begin{itemize}", "latex"), ("~\\cite{x}", "latex"),
    ],
)
def test_kinds(text, want):
    assert M.kinds(text) == [want]


@pytest.mark.parametrize("text", ["== Дом ==\nтекст", "=== Дом ===", "* ред", "- ред", "1. ред", "е < 200 m и > 350 m", "15 $ или 20 $", "x_1 е 3 * 4 = 12", "{1, 2, 5}", "бележка [3] и [бел. ред.]", "№ 7 (C#)", "Камък & Вода", "ъгъл 5'30\"", "", None])
def test_plain(text):
    assert M.kinds(text) == []


def test_clean():
    src = "<h2>Води</h2><ul><li>един<li>два</ul>\n'''Река''' [[Арда (река)|Арда]] [[Искър]]{{x|{{y}}}}<ref name=\"a\">б</ref>\n# Глава\n**удебелен** [връзка](https://a.b) ~~стар~~\n\\section{История}\n\\begin{itemize}\\item а\\item б\\end{itemize}\nима $x^2$ и \\emph{нещо}\n```sql\nSELECT '''a''' & b\n```\n| А | Б |\n|---|---|\n| 1 | 2 |\n&bdquo;а&ldquo; [https://a.b сайт]"
    out = M.cleaned(src)
    for part in ("== Води ==", "- един", "- два", "Река Арда Искър\n", "== Глава ==", "удебелен връзка стар", "== История ==", "- а", "$x^2$", "нещо", "```sql\nSELECT '''a''' & b\n```", "| А | Б |\n| 1 | 2 |", "„а“ сайт"):
        assert part in out, part
    assert not [k for k in M.kinds(out.replace("'''a'''", "")) if k in ("html", "wiki")] and "https" not in out
    assert M.cleaned(out) == out and M.cleaned("== x ==\nа") == "== x ==\nа"


def test_repeated_runs(spark, rnd):
    run = " ".join(pseudo_words(rnd, 60))
    own = {i: " ".join(pseudo_words(rnd, 80)) for i in range(8)}
    rows = [(i, f"t{i}", "h1" if i < 5 else "h2", own[i] + "\n" + (run if i in (0, 1, 2) else "")) for i in range(8)]
    rows += [(20, "c", "h1", own[0][:0] + " ".join(pseudo_words(rnd, 50))), (30, None, None, None), (31, None, "h1", ""), (32, "x", "h1", "кратко"), (40, "t7", "h2", own[7]), (41, "y", "h2", run)]
    df = clashing(spark.createDataFrame(rows, PAGE).repartition(4))
    got = {r.page_id: r for r in M.unmarked(df).collect()}
    for i in range(8):
        assert own[i].split()[:60] == got[i].text.split()[:60]
        # a run is covered but for RUN - 1 words at either end; another host and copies of a page don't count
        assert (got[i].boilerplate_words >= 60 - 2 * (M.RUN - 1)) == (i in (0, 1, 2))
    assert got[41].boilerplate_words == 0 and got[40].boilerplate_words == 0 and got[30].text is None and got[30].kinds == [] and got[31].text == "" and got[32].text == "кратко"
    assert M.unmarked(df.limit(0)).count() == 0


def test_runs_are_covered_to_both_ends(spark, rnd):
    vocabulary = pseudo_words(rnd, 300)
    shared = [[rnd.choice(vocabulary) for _ in range(n)] for n in (15, 16, 17, 20, 30, 31, 45)]
    rows = []
    for i in range(60):
        words = []
        for run in rnd.sample(shared, 3):
            words += pseudo_words(rnd, rnd.randint(5, 25)) + run
        rows.append((i, f"t{i % 50}", f"h{i % 7}", " ".join(words)))
    at = {}
    for i, t, h, text in rows:
        words = text.split()
        for k in range(len(words) - M.RUN + 1):
            at.setdefault((h, *words[k : k + M.RUN]), []).append((i, t, k))
    covered = {i: set() for i, *_ in rows}
    for places in at.values():
        if len({t for _, t, _ in places}) > 1:
            for i, _, k in places:
                covered[i].update(range(k, k + M.RUN))
    got = {r.page_id: r for r in M.unmarked(spark.createDataFrame(rows, PAGE).repartition(4)).collect()}
    assert len(got) == len(rows) and sum(map(len, covered.values())) > 1000
    for i, _, _, text in rows:
        assert got[i].text.split() == [w for k, w in enumerate(text.split()) if k not in covered[i]] and got[i].boilerplate_words == len(covered[i])


def test_long_page(spark):
    page = "<p>" + "дума " * 200_000 + "'''край'''"
    r = M.unmarked(spark.createDataFrame([(1, "a", "h", page), (1, "a", "h", page)], PAGE).distinct()).collect()
    assert r[0].kinds == ["html", "wiki"] and r[0].text.endswith("край") and len(r[0].text.split()) == 200_001


TAIL = "удебелен следва дълъг текст, после 5 думи и край"


@pytest.mark.parametrize(
    "opened",
    ["<b ", "<p ", "<!-- ", "<ref>", '<ref name="x">', "<table style ", '<table style="a" ', "<td ", "<h2>", "<script>", "<pre>", "<code>", "{{x ", "{{Шаблон|", "{{x|име=", "{| ", '{| class="a" ', "[[Файл:", "[[Файл:a.jpg|мини|", "[[Категория:",
     "[[", "[[а|", "$$", "\\[", "\\(", "\\begin{equation} ", "\\begin{", "\\footnote{", "\\section{", "\\emph{", "\\cite{", "```", "```sql ", "`", "[1]: https://a.b ", "**", "__", "''", "# ", "\n|- ", "<li ", "&"],
)
def test_what_isnt_closed_loses_no_text(opened):
    # the whole page is one line, as in pages whose line breaks were lost
    out = M.cleaned(f"Увод {opened}{TAIL} [[Арда]] и '''още'''")
    left = [w.lstrip("|`_&").removeprefix("име=") for w in out.split()]
    at = iter(left)
    assert all(w in at for w in f"Увод {TAIL} Арда и още".split()), out


def test_closed_parts_in_any_depth_and_length():
    deep = "{{а|" * 500 + "}}" * 500
    assert M.cleaned(f"Увод {deep}край") == "Увод край" and M.cleaned("\\emph{" * 500 + "дума" + "}" * 500) == "дума"
    long = " ".join(["дума"] * 300)
    assert M.kinds(f"*{long}*") == ["markdown"] and M.cleaned(f"*{long}*") == long


@pytest.mark.parametrize("part", ["<b a ", "{{", "\\a{", "[[", "<!--", "<ref>", "* a *", "$a_", "{|", "<h2>", "a=1 ", "<pre>", "<code>", "<script>", "`a` ", "[[Файл:", "\\[", "[a]: ", "__a ", "**a ", "```", "\\begin{math}", "[a ", "'' "])
def test_repeated_openings_take_linear_time(part):
    began = time.perf_counter()
    M.cleaned("<b " + part * 10_000), M.kinds("x " + part * 10_000)
    assert time.perf_counter() - began < 3
