"""Workbooks that fit a task, each worked off whole.

The rows of every workbook are counted first. Those of at most ``HELD`` rows are dealt
by workbook once, sorted, and go through a task one workbook at a time, where
references, rings, chains and values are plain look-ups. Larger workbooks, and those
that do not name their cells uniquely, take the distributed steps, which give the
same rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.addresses import CELL_REFERENCE, STRING_LITERAL
from ledgerloom.functions.formulas import compiled
from ledgerloom.session import cut

#: Rows of a workbook (cells, edges, outputs) that a task holds at once.
HELD = 50_000
#: Rows that leave a task in one batch.
BATCH = 20_000
REFERENCE, TEXT = re.compile(CELL_REFERENCE), re.compile(STRING_LITERAL)


def larger(rows: DataFrame, weight: Column | None = None, key: str = "workbook_id", most: int | None = None) -> DataFrame:
    """(workbook_id) of the workbooks with more rows than a task holds; few, as they are large.

    A row counts as ``weight`` rows; ``key`` names another group, ``most`` another limit."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return cut(rows.groupBy(key).agg(size.alias("_n")).filter(F.col("_n") > (HELD if most is None else most)).select(key))


def by_workbook(
    rows: DataFrame, large: DataFrame, of_book: Callable[[str, list[tuple]], Iterator[tuple]], schema: str, arrow: pa.Schema
) -> DataFrame:
    """Rows that ``of_book`` makes from the rows of each workbook that is not ``large``.

    The first column of ``rows`` and of what is made is workbook_id, or another key
    of which ``large`` is a table.
    """
    key = rows.columns[0]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for b in batches for row in zip(*map(_plain, b.columns)))
        out: list[tuple] = []
        for workbook_id, own in groupby(every, itemgetter(0)):
            if workbook_id is None:
                continue
            for row in of_book(workbook_id, own):
                out.append(row)
                if len(out) >= BATCH:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    small = rows.join(F.broadcast(large), key, "left_anti")
    return small.repartition(key).sortWithinPartitions(key).mapInArrow(made, schema)


def _plain(column: pa.Array) -> list:
    """``to_pylist`` without an object of Arrow's for every value."""
    if pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    values, missing = column.fill_null(0).to_numpy().tolist(), column.is_null().to_numpy(zero_copy_only=False).tolist()
    return [None if m else v for v, m in zip(values, missing)]


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


# -- references ------------------------------------------------------------------


def formula_edges(formulas: DataFrame, large: DataFrame) -> DataFrame:
    """(workbook_id, src, dst) without repeats, for the workbooks that are not ``large``.

    ``formulas``: workbook_id, tab_key, col, row, node, formula.
    """
    rows = formulas.select("workbook_id", "node", "tab_key", F.col("col").cast("int"), F.col("row").cast("int"), "formula")
    arrow = pa.schema([(n, pa.string()) for n in ("workbook_id", "src", "dst")])
    return by_workbook(rows, large, _edges_of, "workbook_id string, src string, dst string", arrow)


def _edges_of(workbook_id: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    columns: dict[tuple, dict[int, list]] = {}
    referring: dict[str, list[tuple]] = {}
    for _, node, tab, col, row, formula in rows:
        if tab is not None and col is not None and row is not None:
            columns.setdefault((tab, col), {}).setdefault(row, []).append(node)
        referring.setdefault(node, []).append((tab, formula))
    sorted_rows: dict[tuple, list[int]] = {}
    for src, own in referring.items():
        seen = {}
        for tab, formula in own:
            for sheet, c1, c2, r1, r2 in _boxes(formula):
                for key in _columns_in(columns, tab if sheet is None else sheet, c1, c2):
                    held = columns[key]
                    for row in _rows_in(held, sorted_rows, key, r1, r2):
                        seen.update(dict.fromkeys(held[row]))
        for dst in seen:
            yield workbook_id, src, dst


def _columns_in(columns: dict, tab: str, c1: int, c2: int) -> list[tuple]:
    """Keys (tab, column) that hold something, from c1 to c2."""
    if c2 - c1 < len(columns):
        return [(tab, c) for c in range(c1, c2 + 1) if (tab, c) in columns]
    return sorted(k for k in columns if k[0] == tab and c1 <= k[1] <= c2)


def _rows_in(held: dict, sorted_rows: dict, key: tuple, r1: int, r2: int) -> list[int]:
    """Rows r1 to r2 of one column that hold something."""
    if r2 - r1 < 8:
        return [r for r in range(r1, r2 + 1) if r in held]
    rows = sorted_rows.get(key)
    if rows is None:
        rows = sorted_rows[key] = sorted(held)
    return rows[bisect_left(rows, r1):bisect_right(rows, r2)]


# -- chains and values --------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _corner(ref: str) -> tuple[int, int]:
    letters = ref.rstrip("0123456789")
    column = 0
    for ch in letters:
        column = column * 26 + ord(ch) - 64
    return column, int(ref[len(letters):])


@lru_cache(maxsize=1 << 14)
def _boxes(formula: str) -> list[tuple[str | None, int, int, int, int]]:
    """(sheet, c1, c2, r1, r2) of each reference in a formula, as ``graph.references`` reads it."""
    found = []
    for m in REFERENCE.finditer(TEXT.sub('""', formula)):
        quoted, plain, first, last = m.groups()
        first = first.replace("$", "").upper()
        (ca, ra), (cb, rb) = _corner(first), _corner(last.replace("$", "").upper() if last else first)
        found.append((quoted or plain, min(ca, cb), max(ca, cb), min(ra, rb), max(ra, rb)))
    return found


@lru_cache(maxsize=1 << 14)
def _blocks(first: int, last: int) -> list[tuple[int, int]]:
    """``ranges.blocks`` of rows first..last as (level, block)."""
    if first == last:
        return [(0, first)]
    begin, end = [first], [last + 1]
    for _ in range(3):
        begin.append(-(-begin[-1] // 64))
        end.append(end[-1] // 64)
    run = lambda level, a, b: [(level, n) for n in range(a, b)]
    made = run(3, begin[3], end[3])
    for level in (2, 1, 0):
        a, b, x, y = begin[level], end[level], begin[level + 1], end[level + 1]
        made = run(level, a, x * 64) + made + run(level, y * 64, b) if x < y else run(level, a, b)
    return made


def cyclic_nodes(edges: list[tuple[str, str]]) -> set[str]:
    """Nodes on a cycle of the edges: components of more than one node, and nodes with an edge to themselves."""
    ahead: dict[str, set[str]] = {}
    behind: dict[str, list[str]] = {}
    for src, dst in edges:
        ahead.setdefault(src, set()).add(dst)
    for src, dsts in ahead.items():
        for dst in dsts:
            behind.setdefault(dst, []).append(src)
    left = {src: len(dsts) for src, dsts in ahead.items()}
    ended = [n for n in behind if n not in ahead]
    while ended:  # nodes from which no cycle can be reached go, last ones first
        for src in behind.get(ended.pop(), ()):
            left[src] -= 1
            if not left[src]:
                del left[src]
                ended.append(src)
    found, index, low, on, stack = set(), {}, {}, set(), []
    for start in left:
        if start in index:
            continue
        walk = [(start, iter(ahead[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while walk:
            node, nexts = walk[-1]
            for to in nexts:
                if to not in left:
                    continue
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    walk.append((to, iter(ahead[to])))
                    break
                if to in on:
                    low[node] = min(low[node], index[to])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == index[node]:
                    ring = []
                    while not ring or ring[-1] != node:
                        ring.append(stack.pop())
                        on.discard(ring[-1])
                    if len(ring) > 1 or node in ahead[node]:
                        found.update(ring)
    return found


def _arithmetic(tokens: list[dict], operands: dict[int, float]) -> float | None:
    """``formulas.evaluate`` of operands that are known; a division by zero gives none."""
    stack: list[float | None] = []
    for t in tokens:
        op = t["op"]
        if op == "n":
            stack.append(t["num"])
        elif op == "v":
            stack.append(operands.get(t["arg"]))
        elif op == "neg":
            stack[-1] = None if stack[-1] is None else -stack[-1]
        else:
            y = stack.pop()
            x = stack[-1]
            if x is None or y is None:
                stack[-1] = None
            elif op == "+":
                stack[-1] = x + y
            elif op == "-":
                stack[-1] = x - y
            elif op == "*":
                stack[-1] = x * y
            else:
                stack[-1] = x / y if y != 0 else None
    return stack[-1]


def _in_order(terms: list[tuple[int, float]], width: int) -> float:
    """Sum in order of place: stretches of ``width`` places, then their sums."""
    terms.sort()
    total, part, now = 0.0, 0.0, None
    for at, value in terms:
        if at // width != now:
            total, part, now = total + part, 0.0, at // width
        part += value
    return total + part


class Unfit(Exception):
    """A workbook that must go through the distributed steps."""


class Book:
    """One workbook: its cells by name and place, what its outputs reach, and values."""

    def __init__(self, rows: Iterator[tuple], fold_width: int, cycles_given: bool) -> None:
        self.cells: dict[str, tuple] = {}
        self.columns: dict[tuple, dict[int, str]] = {}
        self.roots: dict[str, None] = {}
        edges, cyclic = [], set()
        for _, kind, node, dst, tab, col, row, formula, num, text, reason in rows:
            if kind == "e":
                if node is not None and dst is not None:
                    edges.append((node, dst))
                continue
            if node is None:
                raise Unfit
            if kind == "o":
                self.roots[node] = None
            elif kind == "y":
                cyclic.add(node)
            else:
                if tab is None or col is None or row is None or node in self.cells:
                    raise Unfit
                held = self.columns.setdefault((tab, col), {})
                if row in held:
                    raise Unfit
                held[row] = node
                self.cells[node] = (tab, formula, num, text, reason)
        self.fold_width = fold_width
        self.cyclic = cyclic if cycles_given else cyclic_nodes(edges)
        self.sorted_rows: dict[tuple, list[int]] = {}
        self.formula_rows: dict[tuple, list[int]] = {}
        self.totals: dict[tuple, tuple[float | None, bool]] = {}
        self.ahead: dict[str, list[str]] = {}
        for src, dst in dict.fromkeys(edges):
            to = self.cells.get(dst)
            if to is not None and to[1] is not None and self._is_open(src):
                self.ahead.setdefault(src, []).append(dst)
        self.reached = self.walk(*self.roots)
        self.values: dict[str, float | None] = {}
        self.todo = {n for n in self.reached if self._is_open(n)}
        for node in self.todo:
            self._settle(node)

    def _is_open(self, node: str) -> bool:
        own = self.cells.get(node)
        return own is not None and own[1] is not None and own[4] is None and node not in self.cyclic

    def walk(self, *roots: str) -> dict[str, int]:
        """Depth of each node that the roots reach through open formulas."""
        depth, front, n = dict.fromkeys(roots, 0), list(roots), 0
        while front:
            n += 1
            onward = []
            for node in front:
                for dst in self.ahead.get(node, ()):
                    if dst not in depth:
                        depth[dst] = n
                        onward.append(dst)
            front = onward
        return depth

    def _settle(self, node: str) -> None:
        """Value of a formula, after those of the formulas it needs."""
        stack, opened = [node], set()
        while stack:
            at = stack[-1]
            if at in self.values:
                stack.pop()
                continue
            if at not in opened:
                opened.add(at)
                waits = [d for d in self.ahead.get(at, ()) if d in self.todo and d not in self.values and d not in opened]
                if waits:
                    stack += waits
                    continue
            self.values[at] = self._value(at)
            stack.pop()

    def _value(self, node: str) -> float | None:
        own = self.cells[node]
        plan = compiled(own[1])
        if plan is None:
            return None
        operands: dict[int, float | None] = {}
        sums: dict[int, list] = {}
        for ref in plan["refs"]:
            tab = ref["sheet"] or own[0]
            arg = ref["arg"]
            if not ref["is_sum"]:
                col, row = _corner(ref["first"])
                operands[arg] = self._of(self.columns.get((tab, col), {}).get(row))
                if operands[arg] is None:
                    return None
                continue
            terms = sums.setdefault(arg, [])
            (ca, ra), (cb, rb) = _corner(ref["first"]), _corner(ref["last"] or ref["first"])
            c1, r1, r2 = min(ca, cb), min(ra, rb), max(ra, rb)
            for key in _columns_in(self.columns, tab, c1, max(ca, cb)):
                start = ref["place"] + (key[1] - c1) * (r2 - r1 + 1) - r1
                if not self._add(terms, key, start, r1, r2):
                    return None
        for arg, terms in sums.items():
            operands[arg] = _in_order(terms, self.fold_width)
        return _arithmetic(plan["tokens"], operands)

    def _of(self, node: str | None) -> float | None:
        """What a cell is worth to a formula: blank cells are zero, texts nothing."""
        if node is None:
            return 0.0
        _, formula, num, text, _ = self.cells[node]
        if formula is not None:
            return self.values.get(node)
        return num if num is not None else 0.0 if text is None else None

    def _add(self, terms: list, key: tuple, start: int, r1: int, r2: int) -> bool:
        """Add rows r1..r2 of a column to the terms; false where one has no value."""
        held = self.columns[key]
        whole = [(level, block) for level, block in _blocks(r1, r2) if level] if r2 - r1 >= 63 else ()
        if whole:  # blocks are next to each other; formulas in them count by themselves
            a, b = whole[0][1] * 64 ** whole[0][0], (whole[-1][1] + 1) * 64 ** whole[-1][0]
            if key not in self.formula_rows:
                self.formula_rows[key] = sorted(r for r, n in held.items() if self.cells[n][1] is not None)
            live = self.formula_rows[key]
            rows = [
                *_rows_in(held, self.sorted_rows, key, r1, a - 1), *live[bisect_left(live, a):bisect_left(live, b)],
                *_rows_in(held, self.sorted_rows, key, b, r2)]
        else:
            rows = _rows_in(held, self.sorted_rows, key, r1, r2)
        for row in rows:
            value = self._of(held[row])
            if value is None:
                return False
            terms.append((start + row, value))
        for level, block in whole:
            value, missing = self._total(key, level, block)
            if missing:
                return False
            if value is not None:
                terms.append((start + block * 64**level, value))
        return True

    def _total(self, key: tuple, level: int, block: int) -> tuple[float | None, bool]:
        """Sum of the plain cells in a block, added level by level; none where there are none."""
        got = self.totals.get((key, level, block))
        if got is not None:
            return got
        held = self.columns[key]
        width = 64**level
        rows = _rows_in(held, self.sorted_rows, key, block * width, (block + 1) * width - 1)
        total, missing, some = 0.0, False, False
        if level == 1:
            for row in rows:
                if self.cells[held[row]][1] is None:
                    value = self._of(held[row])
                    missing, some = missing or value is None, True
                    total += value or 0.0
        else:
            for part in sorted({row // (width // 64) for row in rows}):
                value, none = self._total(key, level - 1, part)
                if value is not None or none:
                    missing, some = missing or none, True
                    total += value or 0.0
        self.totals[key, level, block] = got = (total if some else None, missing)
        return got

    # -- what is asked of it

    def boxes(self, node: str) -> list[tuple]:
        """(tab, c1, c2, r1, r2) of each reference in a formula."""
        own = self.cells[node]
        return [(own[0] if sheet is None else sheet, c1, c2, r1, r2) for sheet, c1, c2, r1, r2 in _boxes(own[1])]

    def covered(self, nodes) -> dict[tuple, list[list[int]]]:
        """Rows that the formulas refer to: (tab, column) to disjoint intervals in order."""
        spans: dict[tuple, set] = {}
        for node in nodes:
            for tab, c1, c2, r1, r2 in self.boxes(node):
                for col in range(c1, c2 + 1):
                    spans.setdefault((tab, col), set()).add((r1, r2))
        merged = {}
        for key, found in spans.items():
            out: list[list[int]] = []
            for r1, r2 in sorted(found):
                if out and r1 <= out[-1][1] + 1:
                    out[-1][1] = max(out[-1][1], r2)
                else:
                    out.append([r1, r2])
            merged[key] = out
        return merged

    def is_odd(self, node: str) -> bool:
        _, formula, num, text, _ = self.cells[node]
        return formula is None and num is None and text is not None

    def leaves(self, covered: dict) -> list[str]:
        """Plain cells in the intervals."""
        found = []
        for key, intervals in covered.items():
            held = self.columns.get(key)
            if held:
                for r1, r2 in intervals:
                    found += [held[r] for r in _rows_in(held, self.sorted_rows, key, r1, r2) if self.cells[held[r]][1] is None]
        return found

    def state(self, node: str) -> tuple:
        """(formula, value, is_supported, reason, is_blank)"""
        own = self.cells.get(node)
        if own is None:
            if node in self.cyclic:
                return None, None, False, RING, True
            return None, 0.0, True, None, True
        _, formula, num, text, unsupported = own
        if node in self.cyclic:
            return None, None, False, RING, False
        if formula is None:
            if self.is_odd(node):
                return None, None, False, f"is no number but used as one ('{text}')", False
            return None, 0.0 if num is None else num, True, None, False
        if unsupported is not None:
            return formula, None, False, f"uses {unsupported}: {formula}", False
        return formula, self.values.get(node), True, None, False


#: Why a cell on a cycle is not rebuilt.
RING = "lies on a ring of references"


def size(covered: dict) -> int:
    return sum(r2 - r1 + 1 for intervals in covered.values() for r1, r2 in intervals)
