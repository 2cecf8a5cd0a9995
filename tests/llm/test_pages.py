import time

from quadrille.llm import html_extract


def test_unclosed_raw_elements_take_linear_time():
    """A megabyte of start tags without an end tag; what closes before them still closes."""
    for name in ("select", "template", "svg", "object"):
        page = f"<p>one<{name}>gone</{name}>two<p>" + f"<{name}>" * (1_000_000 // (len(name) + 2)) + "three"
        t = time.perf_counter()
        _, blocks = html_extract.parse(page)
        assert [b for _, b in blocks] == ["onetwo", "three"] and time.perf_counter() - t < 8, name
