import time

import pytest

from tarnbeck.llm.html_text import blocks, main_text, model

PROSE = "The river rose for three days before anyone in the town thought to move the grain. "


def text(page):
    return main_text(page, *model())


@pytest.mark.parametrize("part", ["<a ", "<!", "</", '<a ="', "<a ='x\">", "<script>x</script", "<div>", "</p>", "<div></x>", "<p><b>w", "<!--", "&amp", "<"])
def test_time_is_linear(part):
    begun = time.monotonic()
    blocks(part * (400_000 // len(part)))
    assert time.monotonic() - begun < 5


def test_deep_pages():
    n = 30_000
    begun = time.monotonic()
    found = blocks("<div>w" * n + "</div>v" * n)
    assert len(found) == 2 * n and time.monotonic() - begun < 5


def test_plain_div_pages_are_kept():
    first, second = (PROSE * 4).strip(), (PROSE * 2).strip()
    assert text(f"<div><a href=/>Home</a> <a href=/n>News</a></div><div>{first}</div><div>{second}</div>") == f"{first} {second}"


def test_controls_and_hidden_elements_have_no_text():
    inner = "<button>Share</button><select><option>A<option>B</select><label>L <input></label><p hidden>h</p><div style='color:red; display: none'>d</div>"
    assert [b[0] for b in blocks(f"<article><p>One.</p>{inner}<p>Two.</p></article>")] == ["One.", "Two."]
    assert [b[0] for b in blocks("<p class=hidden-gem data-hidden=1>seen")] == ["seen"]


def test_classes_that_tell_of_a_lack():
    assert blocks('<div class="no-comments-here has-sidebar">x</div>')[0][1] == frozenset()
    assert blocks('<div class="user-comments">x</div>')[0][1] == {"w:comments"}


def test_cut_tags_and_quotes():
    assert [b[0] for b in blocks("<p>a</p><p>b <a href='x")] == ["a", "b"]
    assert [b[0] for b in blocks('<p>a <a href="x>b</a> c</p><p>d</p>')] == ["a b c", "d"]
    assert [b[0] for b in blocks("<p>1 < 2 and 3 > 2</p>")] == ["1 < 2 and 3 > 2"]
