"""Markup nested to any depth, and where the languages come from."""

import pytest

from sedimenta.llm import markup

DEEP = [
    (r"\emph{" * 8 + "x" + "}" * 8, "x", {"latex"}),
    (r"\section{A \emph{b \textbf{c \texttt{d}}}} e", "A b c d\n\ne", {"latex"}),
    (">" * 15 + " deep", "  " * 15 + "deep", {"markdown"}),
    ("> > a\n> > b\n>\n> c\n\nd", "    a b\n\n  c\n\nd", {"markdown"}),
    ("**a *b **c *d* c** b* a** and ***both***", "a b c d c b a and both", {"markdown"}),
    ("'''bold ''it'' bold'''", "bold it bold", {"wiki"}),
    ("- a\n" + "\n".join("  " * k + "- x" for k in range(1, 13)), "- a\n" + "\n".join("  " * k + "- x" for k in range(1, 13)), set()),
    ("<title>t</title> shown **x**</i>", "shown x", {"html", "markdown"}),
    (r"\begin{center}mid\end{center} \label{a _b_ **c**}", "mid", {"latex"}),
    ("<table><td>cell<td>two</table>", "cell   two", {"html"}),
    (r"`a\_b` and \_ \textbf{x}", r"a\_b and _ x", {"markdown", "latex"}),
]


@pytest.mark.parametrize("text,clean,found", DEEP)
def test_markup_of_any_depth(text, clean, found):
    assert markup.clean_text(text) == (clean, found)


def test_languages_come_from_the_tree():
    root = markup.read("**a** <i>b</i> [[c]] $d$ &amp; {{t}}")
    of = {(n.tag, n.attrs["of"]) for n in root.walk() if "of" in n.attrs}
    assert of == {("strong", "markdown"), ("i", "html"), ("a", "wiki"), ("code", "latex"), ("#entity", "html"), ("#mark", "wiki")}
    assert markup.languages(root) == {"markdown", "html", "wiki", "latex"} and markup.read("plain") is None


LONG = [r"\emph{" * 20_000 + "x" + "}" * 20_000, ">" * 20_000 + " x", "**a " * 20_000 + "b** " * 20_000, "*a " * 20_000, " " * 20_000 + "- x", "{{x|" * 20_000, "[a](b" * 20_000, "\n".join(">" * k + " x" for k in range(500)), "<ul><li>x" * 20_000]


@pytest.mark.parametrize("text", LONG)
def test_long_runs_of_marks(text):
    clean, _ = markup.clean_text(text)
    assert all(c in clean for c in "xab" if c in text.replace("emph", "").replace("](b", ""))


def test_long_field_names():
    long = "a_name_of_a_column_that_is_longer_than_forty_one_characters"
    assert markup.clean_any(f"{long}: # Head", "fields") == (f"{long}: Head", ["markdown"])


@pytest.mark.parametrize(
    "text,clean,found",
    [
        (r"\(a `b` c\)", "a b c", {"latex", "markdown"}), (r"\label{x `y`} z", "z", {"latex", "markdown"}), ("{{note|<b>x</b>}} y", "y", {"wiki", "html"}), ("<img alt=\"`x`\"> y", "x y", {"html", "markdown"}),
        ("[l](u_`c`_v) w", "l w", {"markdown"}), ("$$ <!-- c --> x $$", "x", {"latex", "html"}),
    ],
)
def test_marks_within_what_is_set_aside(text, clean, found):
    got = markup.clean_text(text)
    assert (got[0].split(), got[1]) == (clean.split(), found)


def test_no_inner_tag_is_ever_left():
    import random

    rng = random.Random(11)
    marks = ["**", "__", "*", "_", "***", "`", "```\n", "# ", "> ", "- ", "| a | b |\n", "| - | - |\n", "[x](y)", "![i](j)", "[[w|l]]", "{{t|", "}}", "''", "'''", "{|\n", "|}\n", "\\emph{", "}", "{", "\\section{", "\\item "]
    marks += ["\\begin{itemize}\n", "\\end{itemize}\n", "&", "$", "$$", "\\(", "\\)", "&amp;", "<!-- c -->", "<b>", "</b>", "<table>", "<td>", "<img alt='", "'>", "\ufdd0", "\n", "\n\n", " ", "word"]
    for _ in range(1500):
        text, found = markup.clean_text("".join(rng.choices(marks, k=rng.randint(0, 50))))
        assert not any("\ufdd0" <= c <= "\ufdef" for c in text) and found <= set(markup.LANGUAGES)


def test_blank_lines_in_a_wiki_table():
    assert markup.clean_text("{|\n\n! h1 !! h2\n\n|-\n| a || b\n\n|}")[0] == "h1   h2\na    b"
