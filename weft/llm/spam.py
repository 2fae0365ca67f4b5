"""Pages of repeated keywords, bare link lists or product tags instead of sentences.

A page's own content is compressed block-wise, as a whole with its markup, in its shape and sentence by sentence, and set against what prose of that length and
language compresses to. Extreme redundancy in one of these raises suspicion. It is confirmed by the punctuation of sentences: if the lesser part of
the words stands in stretches that a mark ends and that are not redundant by themselves, the page is spam.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from weft.llm.boilerplate import Page
from weft.llm.prose import Measures, Yardstick


def stuffed(blocks: Sequence[tuple[str, str, bool]], yard: Yardstick | None = None) -> bool:
    """Whether blocks (tag, text, mostly linked) are stuffing rather than sentences: extremely redundant, and confirmed by low density of sentence marks.

    A refrain is redundant, but its sentences are sentences; a few lines without a mark that are not redundant are merely short. Blocks without words are no stuffing.
    """
    return (yard or Yardstick()).stuffed(Measures(blocks))


def own_blocks(page: Page, marginals: list[float]) -> list[tuple[str, str, bool]]:
    """The page's own content: the blocks that the page model takes for main content, without headings.

    Where that is less than a sentence or two, long unlinked blocks that are no standing phrases are taken too, for the model can be at a loss with pages that have no sentence.
    """
    own = [i for i in page.leaves if marginals[i] > 0.5]
    if sum(page.below[i][6] for i in own) < 20:
        own += [i for i in page.leaves if marginals[i] <= 0.5 and page.below[i][6] >= 20 and page.nodes[i].linked == 0 and not page.below[i][5]]
    nodes = [page.nodes[i] for i in own]
    return [(n.tag, n.text, 2 * n.linked > len(n.text)) for n in nodes if not re.fullmatch(r"h[1-6]", n.tag) and n.text != page.title]


def is_spam(page: Page, marginals: list[float], yard: Yardstick | None = None) -> bool:
    """Whether the page's own content is stuffing for its greater part."""
    return stuffed(own_blocks(page, marginals), yard)
