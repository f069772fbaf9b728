import hashlib
import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clubspark.llm import pii
from clubspark.llm.common import table
from clubspark.llm.queries import QUERIES
from tests.llm.conftest import plain, texts_of


def slow_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(sum(divmod(d, 10)) for d in doubled) % 10 == 0


def slow_base(text):
    """The rules as they are stated, with no care for long texts."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and slow_luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


PARTS = st.sampled_from(
    ["a@b.c", "@", ".", "x_y", "%", "-", " ", "1.2.3.4", "256", "300.1.1.1", "0255", "4111111111111111", "4111 1111 1111 1111", "+1 (5", ") 555-0100", "é", "٣", "+", "9" * 12]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_base(text)


def test_long_texts_take_linear_time():
    for part in ("a", "1", "1.", "@", "a@", "+1", "+1(", "1 ", "a.b"):
        pii.base_spans(part * 300_000)


def slow_words(text, spans):
    return [m.span() for m in re.finditer(r"[^\W_]+", text) if not any(s < m.end() and m.start() < e for s, _, e in spans)]


def slow_find(rows, disclosure=pii.DISCLOSURE, support=pii.SUPPORT):
    together, contexts, holding, has, places = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), []
    for i, text in enumerate(rows):
        spans = slow_base(text)
        for w in re.findall(r"[^\W_]+", text):
            has[w.lower()].add(i)
            has[pii.word_class(w)].add(i)
        words = slow_words(text, spans)
        for s, kind, e in spans:
            name = pii.entity(kind, text[s:e])
            near = [w for w in words if w[0] < s][-pii.WINDOW :] + [w for w in words if w[0] >= e][: pii.WINDOW]
            around = tuple(text[b:f].lower() for b, f in near)
            holding[name].add(i)
            for b, f in near:
                for t in (text[b:f].lower(), pii.word_class(text[b:f])):
                    together[name, t].add(i)
                    contexts[name, t].add(around)
                places.append((i, b, f, name, text[b:f]))

    def told(name, t):
        known = math.log(len(rows) / len(holding[name]))
        gain = math.log(len(together[name, t]) * len(rows) / (len(holding[name]) * len(has[t])))
        return len(contexts[name, t]) >= support and known > 0 and gain >= disclosure * known

    added = defaultdict(dict)
    for i, b, f, name, word in places:
        if told(name, word.lower()):
            kind = "remove" if told(name, pii.word_class(word)) else "generalise"
            added[i][b, f] = max(kind, added[i].get((b, f), kind))
    out = []
    for i, text in enumerate(rows):
        every = [(s, k, e) for s, k, e in slow_base(text)]
        every += [(b, len(pii.KINDS) + pii.ADDED.index(k), f) for (b, f), k in added[i].items()]
        out.append([((*pii.KINDS, *pii.ADDED)[k], s, e) for s, k, e in sorted(every)])
    return out


def small_corpus():
    rows = [f"the clerk number {i} wrote about item{i % 7} on day {i}" for i in range(60)]
    rows += [f"day {i} write to Kestrel office kestrel.dean@mail.example or ask for item{i % 7}" for i in range(6)]
    rows += ["copied line near Heron heron@mail.example here"] * 5
    rows += [f"call {i} X{i % 2}7q at +1 (555) 555-0100 the agent" for i in range(5)]
    return rows


def test_words_that_disclose(spark):
    rows = small_corpus()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: list(zip(r.kinds, r.starts, r.ends, strict=True)) for r in pii.find(df).collect()}
    assert [got[i] for i in range(len(rows))] == slow_find(rows)
    marked = {rows[i][s:e] for i, spans in got.items() for k, s, e in spans if k in pii.ADDED}
    assert "Kestrel" in marked and not marked & {"the", "Heron", "day"}  # one surrounding, however often copied, is no evidence
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "kestrel" not in " ".join(clean.values()).lower() and "<email>" in clean[60]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op11_pii"](spark, folder).collect()}
    rows = texts_of(table(spark, folder, "documents"))
    for r, spans in zip(rows, slow_find([r.text for r in rows]), strict=True):
        base = [f"{k}:{s}:{e}" for k, s, e in spans if k in pii.KINDS]
        out = got[r.doc_id]
        assert out.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert out.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [out.n_email, out.n_ip, out.n_card, out.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]


def test_odd_rows(odd):
    assert len(pii.find(odd).collect()) == odd.count()
    assert pii.sanitise(odd).columns == odd.columns
    assert plain(pii.sanitise(odd), "doc_id", "text", "fp", "sha") == plain(odd, "doc_id", "text", "fp", "sha")
    assert pii.find(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text,clean", [("Mail a@b.c now", "Mail <email> now"), ("at 4111 1111 1111 1111.", "at <card>.")])
def test_sanitised_text(text, clean):
    spans = [(s, e, pii.KINDS[k]) for s, k, e in pii.base_spans(text)]
    assert pii.sanitise_text(text, spans) == clean
