"""What a long block says is read: boilerplate in neutral tags, among article paragraphs."""

import numpy as np
import pytest

from tidemill.llm import htmltext

LEAD = "The city by the river was built in the early century and became known for its music and art."
NEXT = "Several years later officials said that research on the water system had found a different history."


@pytest.fixture(scope="module")
def labeller():
    return htmltext.train()


def test_long_blocks_have_words():
    a, b = (htmltext.features([(t, (1, ("div", "p")), 0.0)])[0] for t in (LEAD, " ".join(["cookies"] * len(LEAD.split()))))
    own = slice(htmltext.PATH_DIM, htmltext.PATH_DIM + htmltext.WORD_DIM)
    assert a[own].any() and b[own].any() and not np.allclose(a[own], b[own])


@pytest.mark.parametrize("said", ["We use cookies on this website to improve your browsing experience and to process data with your consent.", "Buy now and save with free shipping on our best deals, a limited offer at the lowest price today."])
def test_words_tell_in_neutral_tags(labeller, said):
    page = f"<html><body><div class=content><h1>The river</h1><p>{LEAD}</p><p>{NEXT}</p></div><div><p>{said}</p></div></body></html>"
    assert htmltext.extract_many(labeller, [page]) == [f"The river\n{LEAD}\n{NEXT}"]


def test_formulas_and_stand_ins_are_text():
    said = lambda page: [b[0] for b in htmltext.blocks(page)]
    assert said("<p>Area is <math><mi>x</mi><mn>2</mn></math> here.</p>") == ["Area is x2 here."]
    assert said("<p>An <svg><path d='M0'/><text>icon</text></svg> inside</p>") == ["An icon inside"]
    assert said("<object data=a><p>no player</p></object><noscript><p>the article</p></noscript><canvas>a chart</canvas>") == ["no player", "the article", "a chart"]
    assert said("<title>t</title><style>s</style><script>c</script><form><textarea>x</textarea></form>y") == ["y"]
