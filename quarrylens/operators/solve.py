"""The points-to fix points of one build, in the Python of the task that holds its facts.

The functions of a slot are the bits of one number, so that a step along a flow carries all of them at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: source: slot, function; flow: source, target; type: type, function; escape: slot; site: slot, type (of a pointer site),
#: callee and its place; argument: index, value kind, value and the place of its site.
FACT = ("config_hash", "fact", "a", "b", "c")
#: target: slot, its functions and places that call all of them; escaped: slot; edge: places and what else each of them
#: calls; guess: places and the functions of their type that each of them may call too.
SOLVED = "config_hash string, n int, part string, slot string, functions array<string>"

#: Functions in a row, edges in a row, functions in a batch.
_FUNCTIONS, _EDGES, _BATCH = 4_096, 16_384, 65_536


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SOLVED, with places, for rows of FACT, with places, that come sorted by build."""
    config, facts, schema = None, defaultdict(list), None
    for batch in batches:
        schema = schema or pa.struct([batch.schema.field(i) for i in range(len(FACT), batch.num_columns)])
        for build, fact, a, b, c, *place in zip(*(column.to_pylist() for column in batch.columns)):
            if build != config:
                yield from _rows(config, facts, schema)
                config, facts = build, defaultdict(list)
            facts[fact].append((a, b, c, tuple(place)))
    if facts:
        yield from _rows(config, facts, schema)


def members(x: int) -> list[int]:
    """The bits of a number."""
    if x.bit_count() < 4:
        out = []
        while x:
            out.append((x & -x).bit_length() - 1)
            x &= x - 1
        return out
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()


class Build:
    """held: the functions of each slot; escaped: 1 for each slot that escaped."""

    def __init__(self, facts: dict[str, list], joined: bool):
        self.functions: dict[str, int] = {}
        self.slots: dict[str, int] = {}
        self.held: list[int] = []
        self.escaped: list[int] = []
        self.flows: list[list[int]] = []
        #: Flows into parameters: of a slot, by index, the functions that take it.
        self.passes: list[dict[str, int]] = []
        self.types: dict[str, int] = defaultdict(int)
        sources: dict[int, int] = defaultdict(int)
        #: What stands at each place: slot, type, callee.
        self.places: dict[tuple, list] = defaultdict(list)
        for slot, function, *_ in facts["source"]:
            sources[self._slot(slot)] |= 1 << self._function(function)
        lost = {self._slot(slot): 1 for slot, *_ in facts["escape"]}
        if joined:
            for source, target, *_ in facts["flow"]:
                self.flows[self._slot(source)].append(self._slot(target))
            self.flows = [list(set(f)) for f in self.flows]
            for kind, function, *_ in facts["type"]:
                self.types[kind] |= 1 << self._function(function)
            for slot, kind, callee, place in facts["site"]:
                stands = (self._slot(slot), kind, self._function(callee) if callee else None)
                if stands not in self.places[place]:
                    self.places[place].append(stands)
        self.nowhere = self.slots.get("")
        added = self._follow(self.held, sources)
        self._follow(self.escaped, lost)
        if joined and facts["argument"]:
            self._pass_on(facts["argument"], added)

    def _function(self, name: str) -> int:
        return self.functions.setdefault(name, len(self.functions))

    def _slot(self, name: str) -> int:
        if name not in self.slots:
            self.slots[name] = len(self.slots)
            self.held.append(0)
            self.escaped.append(0)
            self.flows.append([])
            self.passes.append({})
        return self.slots[name]

    def _follow(self, seen: list[int], front: dict[int, int]) -> dict[int, int]:
        """Carries bits of slots along the flows; what is new, by slot."""
        added: dict[int, int] = {}
        while front:
            after: dict[int, int] = {}
            for slot, x in front.items():
                x ^= x & seen[slot]
                if not x:
                    continue
                seen[slot] |= x
                added[slot] = added.get(slot, 0) | x
                for target in self.flows[slot]:
                    after[target] = after.get(target, 0) | x
                for index, takers in self.passes[slot].items():
                    of = self.parameters[index]
                    for function in members(takers):
                        after[of[function]] = after.get(of[function], 0) | x
            front = after
        return added

    def _pass_on(self, arguments: list, added: dict[int, int]) -> None:
        """Rounds: what a site passes goes into the parameters of its new targets, those of type-only ones escape."""
        given, named, asked = defaultdict(set), set(), defaultdict(set)
        for index, value_kind, value, place in arguments:
            passed = None
            if value_kind is not None:
                passed = (index, value_kind == "function", self._function(value) if value_kind == "function" else self._slot(value))
            for slot, kind, callee in () if None in place else self.places.get(place, ()):
                if kind is not None:
                    asked[kind, index].add(slot)
                if passed and slot != self.nowhere:
                    given[slot].add(passed)
                if passed and callee is not None:
                    named.add((callee, passed))
        names = list(self.functions)
        self.parameters = {index: [self._slot(f"P|{name}|{index}") for name in names] for index in {a[0] for a in arguments}}
        fresh = [(x, given[slot]) for slot, x in added.items() if slot in given] + [(1 << callee, [passed]) for callee, passed in named]
        while True:
            sources, lost, new_flows = defaultdict(int), {}, defaultdict(int)
            for x, what in fresh:
                takers = members(x)
                for index, is_function, value in what:
                    if is_function:
                        of, bit = self.parameters[index], 1 << value
                        for function in takers:
                            sources[of[function]] |= bit
                    else:
                        new_flows[value, index] |= x
            for (kind, index), slots in asked.items():
                left = self.types.get(kind, 0)
                common, is_open = left, False
                for slot in slots:
                    if slot == self.nowhere or self.escaped[slot]:
                        is_open = True
                        common &= self.held[slot]
                        if not common:
                            break
                if is_open:
                    of = self.parameters[index]
                    lost.update((of[function], 1) for function in members(left ^ common) if not self.escaped[of[function]])
            for (value, index), x in new_flows.items():
                before = self.passes[value].get(index, 0)
                x ^= x & before
                if not x:
                    continue
                self.passes[value][index] = before | x
                of = self.parameters[index]
                if self.held[value]:
                    for function in members(x):
                        sources[of[function]] |= self.held[value]
                if self.escaped[value]:
                    lost.update((of[function], 1) for function in members(x))
            added = self._follow(self.held, sources)
            escaped = self._follow(self.escaped, lost)
            if not added and not escaped:
                break
            fresh = [(x, given[slot]) for slot, x in added.items() if slot in given]


    def calls(self) -> tuple[dict[int, list], dict[int, list], dict[int, list]]:
        """Places by the slot that they call through, by what else they call, and by the functions that they may call too by their type."""
        through, sure, guessed = defaultdict(list), defaultdict(list), defaultdict(list)
        for i, stands in enumerate(self.places.values()):
            calls = may = 0
            slots = {slot for slot, *_ in stands if slot != self.nowhere}
            for slot, kind, callee in stands:
                if callee is not None:
                    calls |= 1 << callee
                if kind is not None and (slot == self.nowhere or self.escaped[slot]):
                    every = self.types.get(kind, 0)
                    may |= every ^ (every & self.held[slot])
            if len(slots) == 1:
                slot = slots.pop()
                through[slot].append(i)
                calls ^= calls & self.held[slot]
            for slot in slots:
                calls |= self.held[slot]
            if calls:
                sure[calls].append(i)
            if may:
                guessed[may].append(i)
        return through, sure, guessed


def _rows(config: str | None, facts: dict[str, list], place: pa.StructType | None) -> Iterator[pa.RecordBatch]:
    if not facts:
        return
    build = Build(facts, config is not None)  # facts without a build join nothing
    through, sure, guessed = build.calls()
    names = pa.array(list(build.functions), pa.string())
    values = list(zip(*build.places)) or [()] * place.num_fields
    places = pa.StructArray.from_arrays([pa.array(list(v), f.type) for v, f in zip(values, place)], fields=list(place))
    slots = list(build.slots)

    def rows():
        for i, x in enumerate(build.held):
            if x:
                functions, at = members(x), through.get(i, ())
                step = max(1, _EDGES // min(len(functions), _FUNCTIONS))
                yield "target", slots[i], at[:step], functions
                for j in range(step, len(at), step):
                    yield "edge", None, at[j : j + step], functions
        for i, x in enumerate(build.escaped):
            if x:
                yield "escaped", slots[i], (), ()
        for part, sets in (("edge", sure), ("guess", guessed)):
            for x, at in sets.items():
                functions = members(x)
                step = max(1, _EDGES // min(len(functions), _FUNCTIONS))
                for i in range(0, len(at), step):
                    yield part, None, at[i : i + step], functions

    def lists(of: list, array: pa.Array) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(o) for o in of])]).astype(np.int32)
        flat = np.concatenate([np.asarray(o, np.int64) for o in of])
        return pa.ListArray.from_arrays(pa.array(offsets), array.take(pa.array(flat)))

    done, size, n = [], 0, 0
    for part, slot, at, functions in rows():
        for i in range(0, max(1, len(functions)), _FUNCTIONS):
            done.append((n, part, slot, functions[i : i + _FUNCTIONS], at))
            n += 1
            size += len(done[-1][3]) + len(at) + 1
            if size >= _BATCH:
                yield _batch(config, done, names, places, lists)
                done, size = [], 0
    if done:
        yield _batch(config, done, names, places, lists)


def _batch(config: str | None, rows: list, names: pa.Array, places: pa.Array, lists) -> pa.RecordBatch:
    n, part, slot, functions, at = zip(*rows)
    columns = {"config_hash": pa.array([config] * len(n), pa.string()), "n": pa.array(n, pa.int32()), "part": pa.array(part), "slot": pa.array(slot, pa.string()),
               "functions": lists(functions, names), "places": lists(at, places)}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
