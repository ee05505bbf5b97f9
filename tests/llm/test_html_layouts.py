"""Pages whose attributes, forms, names or marks mislead: the text stays, what is beside it goes."""

import pytest

from scholia.llm.html_extraction import main_text

A = "The first long paragraph of the page says, in several words, what the page is about, and it goes on for a while."
B = "The second long paragraph adds details, numbers such as 12 and 40, and a conclusion; nobody would call it a menu."
BODY = f"<p>{A}</p><p>{B}</p>"
NAV = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>About us</a></li></ul>"
BOTH = f"{A}\n{B}"


@pytest.mark.parametrize("attributes", [
    'style="overflow: hidden"', 'aria-hidden="false"', 'data-x="not hidden"', "data-hidden", "data-class='sidebar'", 'title="the sidebar, hidden"',
    'style="visibility:hidden-ish"', 'onclick="show(\'menu\')"', 'data-role="navigation"', 'xclass="ads"', "class=text id=story", 'aria-label="advertisement"',
])
def test_attributes_are_read_by_their_name(attributes):
    assert main_text(f"<html><body><div {attributes}>{BODY}</div></body></html>") == BOTH


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "HIDDEN", 'class="x sidebar"', "class=page-footer", 'role="navigation"', "id='cookie_consent'", "hidden='until-found'"])
def test_noise_goes(attributes):
    assert main_text(f"<body><div>{BODY}</div><div {attributes}><p>{A[:60]}</p></div></body>") == BOTH


@pytest.mark.parametrize("page", [
    f"<body><form action=x>{NAV}{BODY}<select><option>one</select></form></body>",
    f"<body><form><div class=widget>{BODY}</div></form></body>",
    *(f"<body><div class='{c}'>{BODY}</div></body>" for c in ("widget", "search", "tags", "legal", "alert", "login", "site-search", "notice")),
    f"<body><div class=legal><div class=widget><p>{A}</p><p>{B}</p></div><div class=sidebar><p>Short.</p></div></div></body>",
])
def test_what_holds_most_of_the_text_is_no_noise(page):
    assert main_text(page) == BOTH


def test_small_forms_and_named_boxes_still_go():
    page = f"<body><div>{BODY}</div><form><p>Your name and your address, please.</p></form><div class=widget><p>Weather: fine, 20 degrees.</p></div></body>"
    assert main_text(page) == BOTH
    comments = "".join(f"<p>Reader {i} says that all of this is wrong, and that nobody ever checked it.</p>" for i in range(9))
    assert main_text(f"<body><div>{BODY}</div><div class=comments>{comments}</div></body>") == BOTH


def test_a_teaser_is_not_the_article():
    assert main_text(f"<body><div>{BODY}</div><article><p>Related short.</p></article></body>").startswith(BOTH)
    assert main_text(f"<body><div><p>Some words beside.</p></div><article>{BODY}</article></body>") == BOTH
