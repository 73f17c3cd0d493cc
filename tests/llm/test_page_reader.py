"""The page reader's tree distances against whole paths, and its cost with deep nesting."""

import random
import time

from tallyline.llm import html_text

NAMES = ("div", "section", "ul", "table", "span", "b")


def random_tree(rng, depth, path, out, blocks):
    """Markup that nests and closes rightly; each text in it with the path of its block elements."""
    for _ in range(rng.randrange(1, 4)):
        name = rng.choice(NAMES)
        inner = path if name in html_text.INLINE else [*path, len(out)]
        out.append(f"<{name}>")
        if rng.random() < 0.7:
            out.append("w" + str(len(blocks)) + " ")
            blocks.append((out[-1].strip(), tuple(inner)))
        if depth and rng.random() < 0.8:
            random_tree(rng, depth - 1, inner, out, blocks)
        out.append(f"</{name}>")


def test_distances_are_those_of_whole_paths():
    rng = random.Random(8)
    for _ in range(200):
        out, texts = [], []
        random_tree(rng, 5, [-1], out, texts)
        reader = html_text.Blocks()
        reader.feed("".join(out))
        reader.close()
        reader.flush()
        where = dict(texts)
        # Inline texts run on in the block around them.
        paths = [where[b["text"].split()[0]] for b in reader.blocks]
        wanted, last = {}, {}
        for i, path in enumerate(paths):
            if i:
                common = next((k for k, (x, y) in enumerate(zip(path, paths[i - 1])) if x != y), min(len(path), len(paths[i - 1])))
                apart = len(path) + len(paths[i - 1]) - 2 * common
                wanted[i - 1, i] = html_text.SMOOTH / (1 + apart / 2)
            parent = path[-2] if len(path) > 1 else None
            key = parent if parent != -1 else None
            if key in last and last[key] != i - 1:
                wanted[last[key], i] = html_text.SMOOTH / 2
            last[key] = i
        assert html_text.edges(reader.blocks) == wanted


def test_unclosed_tags_cost_no_more_than_their_number():
    pages = {
        "open blocks": "<div>text here " * 50_000,
        "ends of nothing": "<div><span>" * 25_000 + "x " + "</b>" * 50_000,
        "open inline": "<span>" * 50_000 + "<p>word " * 20_000,
        "ends out of reach": "<b><div>" * 30_000 + "</i>" * 30_000,
    }
    for name, page in pages.items():
        start = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - start < 20, name
