import random
import re

from sluicegate.llm.licence_sentences import RULES, SENTENCES, scan_licences

MIT = [SENTENCES[n] for n in ("mit grant", "mit condition", "mit warranty")]
APACHE = [SENTENCES[n] for n in ("apache header", "apache compliance")]


def wrapped(text, width=40):
    words, lines = text.split(" "), [""]
    for word in words:
        if len(lines[-1]) + len(word) > width:
            lines.append("")
        lines[-1] = f"{lines[-1]} {word}".strip()
    return "\n".join(lines)


CASES = [
    (None, []),
    ("", []),
    (" \n\x0b . ! ", []),
    ("No licence is stated here.", []),
    ("Some prose.\nReleased under the MIT License.", ["MIT"]),
    ("prose without an end\nRELEASED  under the\tMIT license", ["MIT"]),
    ("Not Released under the MIT License.", []),
    ("A. Licensed under CC BY-NC 4.0. B. Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
    ("Licensed under CC BY-NC 4.0.\n" * 3_000, ["CC-BY-NC-4.0"]),
    (" ".join(MIT), ["MIT"]),
    ("\n".join(MIT), ["MIT"]),
    (wrapped(" ".join(MIT)), ["MIT"]),
    ("\n\n".join(map(wrapped, MIT)), ["MIT"]),
    (" One. Two. ".join(MIT), ["MIT"]),
    (" One. Two. Three. ".join(MIT), []),  # too far apart
    (" ".join([MIT[1], MIT[0], MIT[2]]), []),  # out of order
    (" ".join(MIT[:2]), []),
    (" ".join(APACHE), ["Apache-2.0"]),
    (wrapped(" ".join(APACHE)), ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("é" * 50_000 + ".\nReleased under the MIT License.", ["MIT"]),
]


def test_cases(frame):
    rows = [(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(4, CASES[4][0], "clash"), (None, CASES[4][0], "clash")]
    got = scan_licences(frame(rows, "doc_id bigint, text string, licences string")).collect()
    expected = [(i, w) for i, (_, w) in enumerate(CASES)] + [(4, ["MIT"]), (None, ["MIT"])]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.licences) for r in got), key=key) == sorted(expected, key=key)
    assert {r.doc_id: r.n_known for r in got}[8] == 3_000


def test_empty(frame):
    assert scan_licences(frame([], "doc_id bigint, text string")).collect() == []


def plain_sentences(text, by_line):
    """Names of known sentences, None for others; written without the operator's patterns."""
    bare = lambda s: " ".join(re.findall("[a-z0-9]+", s.lower()))
    names = {bare(s): name for name, s in SENTENCES.items()}
    parts, now = [], ""
    paragraphs = text.split("\n") if by_line else re.split(r"\n[ ]*\n", text)
    for paragraph in paragraphs:
        for word in paragraph.split():
            now += " " + word
            if word.rstrip("'\")")[-1:] in tuple(".!?:;"):
                parts.append(now)
                now = ""
        parts.append(now)
        now = ""
    return [names.get(bare(p)) for p in parts if bare(p)]


def plain_rule_holds(rule, found):
    places = [i for i, name in enumerate(found) if name == rule.sentences[0]]
    for wanted in rule.sentences[1:]:
        places = [j for i in places for j in range(i + 1, min(i + rule.gap + 2, len(found))) if found[j] == wanted]
    return bool(places)


def test_random_texts_against_brute_force(frame):
    draw = random.Random(11)
    said, texts = list(SENTENCES.values()), []
    for _ in range(400):
        rule = draw.choice(RULES)
        parts = []
        for name in rule.sentences:
            parts += [SENTENCES[name], *draw.choices(["Some prose.", "Nothing known here!", draw.choice(said)], k=draw.choice([0, 0, 1, 3, 9]))]
        if draw.random() < 0.2:
            draw.shuffle(parts)
        texts.append(draw.choice([" ", "\n", "\n\n"]).join(parts))
    got = scan_licences(frame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for row in got:
        ways = [plain_sentences(texts[row.doc_id], by_line) for by_line in (True, False)]
        assert row.licences == sorted({r.licence for r in RULES for way in ways if plain_rule_holds(r, way)}), texts[row.doc_id]
    assert len({name for r in got for name in r.licences}) == len({r.licence for r in RULES})
