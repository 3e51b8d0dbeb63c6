"""A small labelled table for the block classifier: pages and, per block in order, 1 for main text.

Written for this package.  ``W<n>`` stands for n words of running text.
"""

from __future__ import annotations

import re

_WORDS = "the river carried small boats past stone walls while people on both banks waited for rain".split()

EXAMPLES = (
    # an article element with a menu, an advert and a footer around it; short paragraphs belong to it
    (
        "<body><nav><ul><li><a href=/a>W1</a><li><a href=/b>W2</a><li><a href=/c>W1</a></ul></nav><div class='ad'>W9</div>"
        "<article><h1>W7</h1><p>W40</p><p>W2</p><p>W90</p><p>W12</p></article><footer>&copy; W6</footer></body>",
        "000 0 11111 0",
    ),
    (
        "<body><header><a href=/>W2</a></header><main><h1>W4</h1><p>W25<p>W3<p>W60 <a href=x>W2</a><ul><li>W8<li>W5</ul></main>"
        "<aside><h3>W2</h3><p>W20</p></aside><footer><p>W15</p></footer></body>",
        "0 111111 00 0",
    ),
    # no article element: long blocks with few links are the text
    (
        "<body><div><a href=1>W1</a> <a href=2>W1</a> <a href=3>W2</a></div><div id=content><h1>W6</h1><p>W55</p><p>W70</p>"
        "<p>W35 <a href=4>W3</a></p></div><div><a href=5>W3</a> <a href=6>W4</a></div><div>W5</div></body>",
        "0 1111 0 0",
    ),
    (
        "<table><tr><td><a href=1>W2</a><td><a href=2>W2</a></table><p>W80</p><p>W15</p><p>W65</p><p><a href=3>W5</a></p><p>W4</p>",
        "00 111 0 0",
    ),
    (
        "<body><div class=menu><a href=1>W2</a></div><div class='cookie-notice'><p>W30</p></div><div><h2>W5</h2><p>W45</p><p>W50</p></div>"
        "<div id='comments'><h3>W2</h3><p>W25</p><p>W33</p></div></body>",
        "0 0 111 000",
    ),
    # a form around the whole page, a marked element around the article
    (
        "<body><form id=aspnetForm><nav><a href=/>W2</a></nav><main><h1>W5</h1><p>W40</p><p>W6</p></main><footer>W9</footer></form></body>",
        "0 111 0",
    ),
    (
        "<body><div class='page-header widget'><article><h1>W4</h1><p>W7</p><p>W50</p></article></div><div class=ad>W12</div></body>",
        "111 0",
    ),
    # furniture inside the article element
    (
        "<article><header><h1>W5</h1></header><p>W30</p><div class='share'><a href=1>W1</a> W2</div><p>W44</p><p>W1</p>"
        "<form><label>W3</label><button>W1</button></form><section class=comments><p>W28</p><p>W9</p></section></article>",
        "11 0 11 00 00",
    ),
    (
        "<article><h1>W8</h1><p>W5</p><p>W6</p><blockquote>W20</blockquote><pre>W14</pre><aside>W30</aside><p>W22</p></article><div class=promo>W40</div>",
        "11111 0 1 0",
    ),
    (
        "<body><nav>W3</nav><article><h1>W3</h1><p>W2</p></article><footer>W30</footer></body>",
        "0 11 0",
    ),
    # link lists within a text and at its end
    (
        "<body><div><h1>W7</h1><p>W60</p><p>W38</p><p>W52</p></div><div><h4>W2</h4><ul><li><a href=1>W6</a><li><a href=2>W7</a><li><a href=3>W5</a></ul></div></body>",
        "1111 0000",
    ),
    (
        "<main><h1>W6</h1><p><a href=1>W5</a></p><p>W30</p><h2>W2</h2><p>W4</p><ol><li>W3<li>W4</ol></main><div class=sidebar><p>W50</p></div>",
        "1111111 0",
    ),
    (
        "<body><form><p>W12</p><button>W2</button></form><div class=newsletter><p>W18</p></div><p>W48</p><p>W33</p><div>W3</div><div><a href=1>W2</a></div></body>",
        "00 0 11 0 0",
    ),
    # the text is the last thing on the page, or links only
    ("<body><nav>W4</nav><article><h1>W3</h1><p>W20</p><p><a href=1>W6</a></p><p>W3</p></article></body>", "0 1111"),
    ("<main><p><a href=1>W3</a></p></main>", "1"),
    ("<article><p>W2</p></article>", "1"),
    ("<article><h1>W5</h1><p>W10</p></article>", "11"),
    ("<article><p>W20</p><p>W15</p></article>", "11"),
    ("<main><p>W8</p></main>", "1"),
    ("<main><p>W30</p><p>W6 <a href=1>W9</a></p><p>W18</p></main>", "111"),
    ("<article><p>W50</p><p><a href=1>W4</a></p></article>", "11"),
    ("<body><p>W50</p><div>W10</div></body>", "1 0"),
    ("<body><div>W14</div><p>W64</p><p>W52</p><div>W16</div></body>", "0 11 0"),
    ("<body><p>W58</p><div>W3 <a href=1>W3</a></div></body>", "1 0"),
    ("<article><h1>W5</h1><p>W70</p></article>", "11"),
    ("<body><p>W60</p><p>W45</p></body>", "11"),
    ("<body><div><a href=1>W2</a></div><p>W75</p></body>", "0 1"),
    ("<body><div class=ad>W35</div><article><p>W1</p><p>W1</p><p>W120</p></article><div class='related'><p>W22</p></div></body>", "0 111 0"),
)


def labelled_pages() -> list[tuple[str, list[int]]]:
    def words(found: re.Match) -> str:
        n = int(found[1])
        return " ".join(_WORDS[k % len(_WORDS)] for k in range(n))

    return [(re.sub(r"W(\d+)", words, html), [int(c) for c in labels if c != " "]) for html, labels in EXAMPLES]
