"""Personal data: fixed patterns, and spans that a linear-chain conditional random field adds.

The field labels words.  Its features are the shape of a word (runs of upper case, lower case and digits, other characters as
they are), the exact shape of words with digits, and the word itself where the training table has it, each for the word and
its two neighbours.  It is trained on a small labelled table by full-batch gradient steps on the penalised log-likelihood
(forward-backward over all sentences at once) on the driver; tasks decode all lines of a block together by Viterbi.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.llm.blocks import Block, bound_batches, LOWER, mix, plain, running, slices, spans, U64

#: Kinds in the order that breaks ties, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
#: The same languages as EMAIL and IP, found in linear time: what stands before an @ is taken from the @ back, and a match of IP
#: begins where a run of digits does, since a later digit of the run has the same continuation.
BEFORE_AT = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")

#: Labels of the field; the first is for words outside any span.
LABELS = ("out", "person", "phone", "id", "email", "address")
MAX_SENTENCES = 5000
#: Bytes of text decoded together: the steps of a block are as many as its longest line has words.
SLICE = 3 << 20


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of ``EMAIL``."""
    left, at = 0, text.find("@")
    while at >= 0:
        begin = left + len(text[left:at].rstrip(BEFORE_AT))
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        left = domain.end() if domain else at + 1
        at = text.find("@", left)


def small_number(digits: str, most: int) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= len(str(most)) and int(digits or 0) <= most


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every pattern match that passes its check, by start, then kind; in time linear in the text."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in IP_RUNS.finditer(text) if all(small_number(p, 255) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def apart_from(new: list[tuple[int, int, str]], old: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans of ``new`` that overlap none of ``old``; ``old`` is sorted by start."""
    starts, reach = [a for a, _, _ in old], list(accumulate((b for _, b, _ in old), max))
    # of those that begin before a span's end, the one that reaches furthest
    return [s for s in new if not (k := bisect_left(starts, s[1])) or reach[k - 1] <= s[0]]


#: Sentences of the labelled table; {person}, {phone}, {id}, {email} and {address} are filled in.
TEMPLATES = (
    "my name is {person} and I live at {address} since then", "please call {person} at {phone} before noon", "Contact: {person} , phone {phone}",
    "her ssn is {id} as given", "SSN: {id}", "social security number {id} belongs to {person}", "passport no. {id} was lost", "IBAN {id} for the payment",
    "write to {email} or call {phone}", "mail {person} at {email} today", "Dear {person} , thank you", "signed by Mr. {person} on Monday", "Mrs. {person} lives at {address}",
    "Dr. {person} can be reached under {phone}", "the parcel goes to {address} by post", "address: {address}", "tel. {phone}", "Tel: {phone}", "e-mail: {email}",
    "the meeting took place on 12.05.2021 at 10:30", "it costs $ 19.99 or 1,250 euros", "in 1998 there were 250 houses", "version 2.0 of the licence", "The and of were here. Then it was.",
    "THE WORDS ARE!! IN CAPITALS!! HERE!!", "words%%% with*** marks&&& and$$$ more###", "one | two | three | four |", "Vièle aile menté de la elle.", "Den mit te ber auf verä das nicht.",
    "Ciónñue de coque una ñiear esuear.", "the order 48213 was sent in 3 boxes", "chapter 12 and page 304 , see above", "All rights reserved.", "Licensed under the Apache License, Version 2.0.",
    "hash 9f86d081884c7d65 of the file", "host 10.0.0.1 and port 8080", "a b c d e f g", "And And And And And And And", "Und Und Und Und Und", "To To To To To to to to", "He said that she would come . They went home .", "token = 5f2d8c3a1b of the day", "In the end 4242 4242 was all",
    "ask for {person} in the office", "{person} wrote this in May", "as {person} said , it rained", "sold to {person} for a small sum", "the letter from {person} came late", "name: {person}", "Name: {person} , born in spring",
    "he was seen with {person} near {address}", "our office is at {address} now", "deliver to {address} , second floor", "moved from {address} to {address}", "Address: {address}", "residence {address} , as before",
    "phone: {phone}", "fax {phone} or mail", "ring {phone} after six", "Call {phone} now", "mobile {phone} , home {phone}", "number {phone} is not in use",
    "tax number {id} of the firm", "ID: {id}", "account {id} was closed", "the card with {id} is blocked", "passport {id} , valid", "license {id} of {person}",
    "contact {email} for more", "E-Mail: {email} , Tel: {phone}", "sent by {email} on Tuesday", "{email} is the sender", "reply to {person} under {email}",
    "page 17 of 230 was missing", "the room 12 is on floor 3", "on 3 May 1987 they left", "about 40 people and 12 dogs", "see figure 3.2 and table 4", "Every day the sun rose over the hill .", "Once upon a time there was a house .",
    "The end of the story is near . Nobody knows why .", "La maison est grande et belle .", "Das Haus ist klein und alt .", "La casa es vieja y grande .", "item 4 : two pens , one book", "ratio 3:4 or 0.75 of it", "at 12:45 the train left",
)
FIRST = (
    "Anna", "Peter", "Maria", "John", "Julia", "Omar", "Lena", "Carlos", "Sofia", "Paul", "Emma", "Liam", "Noah", "Olivia", "Mia", "Lucas", "Ines", "Jorge", "Pierre", "Claire",
    "Hans", "Greta", "Yusuf", "Aisha", "Wei", "Mei", "Ivan", "Olga", "Tom", "Kate", "Nina", "David", "Sarah", "Mark", "Laura", "Alice", "Robert", "Helen", "George", "Diana",
)
LAST = (
    "Smith", "Müller", "García", "Dupont", "Rossi", "Novak", "Brown", "Silva", "Khan", "Weber", "Jones", "Taylor", "Davies", "Wilson", "Schmidt", "Fischer", "López", "Pérez", "Martin", "Bernard",
    "Petit", "Moreau", "Kowalski", "Nowak", "Ivanov", "Petrov", "Chen", "Wang", "Singh", "Patel", "Kim", "Lee", "Nguyen", "Costa", "Santos", "Ferrari", "Bianchi", "Hansen", "Larsen", "Berg",
)
STREETS = (
    "Main Street", "Oak Avenue", "High Road", "Park Lane", "Station Road", "Mill Street", "Church Road", "Elm Drive", "Cedar Court", "Lake View", "River Road", "Hill Street", "King Street", "Queen Avenue", "Maple Drive",
)


def labelled_sentences(spark: SparkSession, copies: int = 12) -> DataFrame:
    """The small labelled table: sentence, no, word, label, filled from templates by a fixed rule."""
    rng = np.random.default_rng(11)
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda x: x[rng.integers(0, len(x))]
    makers = {
        "person": lambda: f"{pick(FIRST)} {pick(LAST)}",
        "phone": lambda: pick([f"({digit(3)}) 555-{digit(4)}", f"555-{digit(3)}-{digit(4)}", f"0{digit(2)}-{digit(7)}", f"+1 ({digit(3)}) 555-{digit(4)}"]),
        "id": lambda: pick([f"{digit(3)}-{digit(2)}-{digit(4)}", f"DE{digit(20)}", f"X{digit(8)}"]),
        "email": lambda: pick([f"{pick(FIRST).lower()}.{digit(2)}@mail{digit(1)}.example.com", f"{pick(FIRST).lower()}@example.org"]),
        "address": lambda: f"{digit(2)} {pick(STREETS)}",
    }
    rows = []
    for n, template in enumerate(TEMPLATES * copies):
        no = 0
        for word in template.split(" "):
            kind = word.strip("{}") if word.startswith("{") else None
            for piece in (makers[kind]() if kind else word).split(" "):
                rows.append((n, no, piece, kind or "out"))
                no += 1
    return spark.createDataFrame(rows, "sentence long, no long, word string, label string")


def _classes() -> np.ndarray:
    out = np.arange(256)
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("a") : ord("z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[0x80:] = 2
    return out.astype(np.uint8)


_CLASS = _classes()
_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def word_features(block: Block) -> np.ndarray:
    """Hashes of each word's shape, exact shape (0 without digits) and lower-case form, as three columns."""
    kind = _CLASS[block.data]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[block.starts] = True
    before = np.concatenate([[0], np.cumsum(first)])
    shape = spans(running(_CODE[kind[first]]), before[block.starts], before[block.ends])
    digits = np.concatenate([[0], np.cumsum(kind == 3)])
    exact = spans(running(_CODE[kind]), block.starts, block.ends)
    exact[digits[block.starts] == digits[block.ends]] = 0
    lower = spans(running(_CODE[LOWER[block.data]]), block.starts, block.ends)
    return np.stack([shape ^ U64(1), np.where(exact == 0, exact, exact ^ U64(2)), lower ^ U64(3)], axis=1)


class Field:
    """A linear-chain conditional random field; feature 0 is for whatever training has not seen."""

    def __init__(self, known: np.ndarray):
        self.known = known
        k = len(LABELS)
        self.weights = np.zeros((3, len(known) + 1, k))  # of the word before, the word, the word after
        self.step = np.zeros((k, k))
        self.begin = np.zeros(k)

    def numbers(self, features: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
        return np.where(self.known[at] == features, at + 1, 0)

    def around(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Feature numbers of the word before, the word and the word after, 0 over the edge of a line."""
        before, after = np.zeros_like(numbers), np.zeros_like(numbers)
        before[1:], after[:-1] = numbers[:-1], numbers[1:]
        full = ends > starts
        before[starts[full]] = 0
        after[ends[full] - 1] = 0
        return [before, numbers, after]

    def emissions(self, sides: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(sides[0]), len(LABELS)))
        for weights, numbers in zip(self.weights, sides):
            for column in numbers.T:
                total += weights[column]
        return total

    def decode(self, scores: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best label of every word; lines advance together, longest first."""
        labels = np.zeros(len(scores), np.int8)
        order = np.argsort(starts - ends, kind="stable")
        starts, length = starts[order], (ends - starts)[order]
        starts, length = starts[length > 0], length[length > 0]
        if not len(length):
            return labels
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right").tolist()
        into = self.step[:, None, :]
        states = np.empty_like(scores)  # of every word: the best score of a path that ends there, by label
        states[starts] = state = scores[starts[: active[0]]] + self.begin
        for t in range(1, length[0]):
            at = starts[: active[t]] + t
            state = (state[: active[t]].T[:, :, None] + into).max(axis=0) + scores[at]
            states[at] = state
        last = starts + length - 1
        labels[last] = states[last].argmax(axis=1)
        before = self.step.T.copy()
        for t in range(length[0] - 1, 0, -1):
            at = starts[: active[t]] + t
            labels[at - 1] = (states[at - 1] + before[labels[at]]).argmax(axis=1)
        return labels


def train(sentences: DataFrame, rounds: int = 150, penalty: float = 0.02) -> Field:
    """Fits a field to the labelled table (at most ``MAX_SENTENCES`` sentences of it, by number)."""
    rows = sentences.where(F.col("sentence") < MAX_SENTENCES).groupBy("sentence").agg(F.sort_array(F.collect_list(F.struct("no", "word", "label"))).alias("words")).orderBy("sentence").collect()
    texts = [" ".join(w.word for w in r.words) for r in rows]
    gold = np.array([LABELS.index(w.label) for r in rows for w in r.words])
    block = Block(pa.array(texts))
    features = word_features(block)
    known, counts = np.unique(features, return_counts=True)
    field = Field(known[(known > 0) & (counts > 1)])
    sides = field.around(field.numbers(features), block.words[:-1], block.words[1:])
    k, starts, ends = len(LABELS), block.words[:-1], block.words[1:]
    length = ends - starts
    width, n = length.max(), len(length)
    place = starts[:, None] + np.minimum(np.arange(width)[None], length[:, None] - 1)
    there = np.arange(width)[None] < length[:, None]
    hot = np.eye(k)
    square = [np.full_like(x, 1e-8) for x in (field.weights, field.step, field.begin)]
    log_sum = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for _ in range(rounds):
        scores = field.emissions(sides)[place]
        alpha, beta = np.zeros((width, n, k)), np.zeros((width, n, k))
        alpha[0] = scores[:, 0] + field.begin
        for t in range(1, width):
            moved = log_sum(alpha[t - 1][:, :, None] + field.step, 1) + scores[:, t]
            alpha[t] = np.where(there[:, t, None], moved, alpha[t - 1])
        for t in range(width - 2, -1, -1):
            moved = log_sum(field.step[None] + (scores[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(there[:, t + 1, None], moved, 0)
        whole = log_sum(alpha[-1], 1)
        each = np.exp(alpha + beta - whole[None, :, None])
        off = np.zeros((len(gold), k))
        off[place[there]] = each.transpose(1, 0, 2)[there]
        off = hot[gold] - off
        grads = [np.zeros_like(field.weights), np.zeros_like(field.step), off[starts].sum(axis=0)]
        for side, numbers in enumerate(sides):
            for column in numbers.T:
                np.add.at(grads[0][side], column, off)
        inner = np.ones(len(gold), bool)
        inner[starts] = False
        np.add.at(grads[1], (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
        for t in range(1, width):
            live = there[:, t]
            pair = alpha[t - 1][live][:, :, None] + field.step + (scores[:, t] + beta[t])[live][:, None, :] - whole[live][:, None, None]
            grads[1] -= np.exp(pair).sum(axis=0)
        for value, grad, seen in zip((field.weights, field.step, field.begin), grads, square):
            grad = grad - penalty * value
            seen += grad * grad
            value += 0.5 * grad / np.sqrt(seen)
    return field


#: Characters that a span of words leaves out at its ends.
EDGE = ".,;:!?()[]{}<>\"'|#$%&*"


def added_spans(field: Field, block: Block, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Per text the (start, end, kind) of runs of words with one label other than ``out``, in code points."""
    starts, ends, _ = block.lines()
    first, last = np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)
    sides = field.around(field.numbers(word_features(block)), first, last)
    labels = field.decode(field.emissions(sides), first, last)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    marked = np.flatnonzero(labels)
    if not len(marked):
        return out
    line = np.searchsorted(last, marked, "right")
    new = np.ones(len(marked), bool)
    new[1:] = (marked[1:] != marked[:-1] + 1) | (labels[marked[1:]] != labels[marked[:-1]]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(marked)) - 1
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    for a, b in zip(marked[begin], marked[end]):
        i = int(np.searchsorted(block.words, a, "right")) - 1
        base = points[block.at[i]]
        x, y = int(points[block.starts[a]] - base), int(points[block.ends[b]] - base)
        while x < y and texts[i][x] in EDGE and not (texts[i][x] == "(" and ")" in texts[i][x:y]):
            x += 1
        while x < y and texts[i][y - 1] in EDGE:
            y -= 1
        if y - x > 1:
            out[i].append((x, y, LABELS[labels[a]]))
    return out


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with counts of base spans, their digest and all spans.

    Null texts count as empty; texts of any length are read whole, in linear time; repeated rows each get their row; a null doc_id stays null; an empty table gives an empty
    result.  Spans that the field adds never overlap a base span.  Offsets are code points, ends exclusive.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda found: ",".join(f"{k}:{a}:{b}" for a, b, k in found)
        order = [*KINDS, *LABELS]
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = plain(part.column(1)).to_pylist()
                base = [base_spans(t) for t in texts]
                added = added_spans(shared.value, Block(part.column(1)), texts)
                free = [apart_from(new, old) for new, old in zip(added, base)]
                counts = {f"n_{kind}": pa.array([sum(s[2] == kind for s in found) for found in base], pa.int64()) for kind in KINDS}
                digests = [hashlib.sha256(name(found).encode()).hexdigest() for found in base]
                every = [name(sorted(old + new, key=lambda s: (s[0], order.index(s[2])))) for old, new in zip(base, free)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), **counts, "base_sha256": digests, "spans": every, "n_added": pa.array(map(len, free), pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
