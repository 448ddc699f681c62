"""Insertion rounds over Arrow batches of packed problems: all problems of a slice grow by one stop per round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of the largest table of a slice (problem, vehicle, gap, node, scenario), fixed to bound memory.
CELLS = 2**21
TOLERANCE = 1e-9
#: Added to an id where the longer of two ids that begin alike goes first.
LAST_LETTER = "\U0010ffff"


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each entry of a list column, and the entries."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _numbers(values: pa.Array, missing: float = np.nan) -> np.ndarray:
    return pc.fill_null(values.cast(pa.float64()), missing).to_numpy(zero_copy_only=False)


def _flags(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, False).to_numpy(zero_copy_only=False)


def _place_in_row(row: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row; rows ascend."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def _odd(mask: np.ndarray, rows: np.ndarray, bad: np.ndarray) -> None:
    mask[rows[bad]] = True


def _repeated(*keys: np.ndarray) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


class Batch:
    """The problems of a batch as arrays. ``odd`` marks those that only the joins of rows treat rightly.

    These have null or repeated keys, depots that are not nodes, or values that are missing.
    """

    def __init__(self, table: pa.RecordBatch):
        n = table.num_rows
        column = {name: table.column(name) for name in table.schema.names}
        self.odd = np.zeros(n, bool)
        for name in ("problem_id", "vehicle_count", "shift_length", "require_return", "depots", "family", "_nodes", "_cases"):
            self.odd |= column[name].is_null().to_numpy(zero_copy_only=False)
        self.vehicles = _numbers(column["vehicle_count"], 0).astype(np.int64)
        self.odd |= self.vehicles < 1
        self.tour = _flags(pc.equal(column["family"], "tsp"))
        self.back, self.shift = _flags(column["require_return"]), _numbers(column["shift_length"])
        self.room = _numbers(column["vehicle_capacity"], np.inf)
        self.odd |= np.isnan(self.shift) | np.isnan(self.room)

        of, nodes = _flat(column["_nodes"])
        names = nodes.field("node_id")
        known = pc.unique(names).drop_null()
        code = lambda values: pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        width = len(known) + 1
        key = of * width + code(names)
        values = {c: _numbers(nodes.field(c)) for c in ("start", "end", "stay", "demand", "worth")}
        bad = names.is_null().to_numpy(zero_copy_only=False) | nodes.field("is_depot").is_null().to_numpy(zero_copy_only=False) | _repeated(key)
        for v in values.values():
            bad |= np.isnan(v)
        _odd(self.odd, of, bad)
        self.place, self.of, self.values, self.names = _place_in_row(of), of, values, names
        self.free = ~_flags(nodes.field("is_depot"))
        self.nodes = np.bincount(of, minlength=n)
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]

        def node(rows: np.ndarray, values: pa.Array) -> np.ndarray:
            wanted, codes = rows * width, code(values)
            at = np.minimum(np.searchsorted(sorted_keys, wanted + codes), max(len(order) - 1, 0))
            if not len(order):
                return np.full(len(rows), -1)
            return np.where((codes >= 0) & (sorted_keys[at] == wanted + codes), self.place[order[at]], -1)

        # Of equal values the best id goes first: a tour takes the shorter of two that begin alike, the others the longer.
        letters = np.array([x or "" for x in names.to_pylist()], dtype=str)
        letters = np.where(self.tour[of], letters, np.char.add(letters, LAST_LETTER)) if len(of) else letters
        self.rank = np.empty(len(of), np.int64)
        self.rank[np.lexsort((letters, of))] = self.place

        of, cases = _flat(column["_cases"])
        scenarios = pc.unique(cases.field("scenario")).drop_null()
        case = pc.fill_null(pc.index_in(cases.field("scenario"), value_set=scenarios), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        _odd(self.odd, of, (case < 0) | _repeated(of, case))
        self.cases = np.bincount(of, minlength=n)
        self.base = np.zeros(n, np.int64)
        is_base = _flags(cases.field("is_base"))
        self.base[of[is_base]] = _place_in_row(of)[is_base]
        wide = len(scenarios) + 1
        case_key = of * wide + case
        order_c = np.argsort(case_key, kind="stable")
        case_place = _place_in_row(of)

        of, arcs = _flat(column["_arcs"])
        told = pc.fill_null(pc.index_in(arcs.field("scenario"), value_set=scenarios), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        arc_key = of * wide + told
        at = np.minimum(np.searchsorted(case_key[order_c], arc_key), max(len(order_c) - 1, 0))
        live = (told >= 0) & (case_key[order_c][at] == arc_key) if len(order_c) else np.zeros(len(of), bool)
        src, dst = node(of, arcs.field("src")), node(of, arcs.field("dst"))
        live &= (src >= 0) & (dst >= 0)
        arc_case = np.where(live, case_place[order_c][at], 0) if len(order_c) else np.zeros(len(of), np.int64)
        self.arcs = tuple(x[live] for x in (of, arc_case, src, dst, _numbers(arcs.field("time"))))
        _odd(self.odd, self.arcs[0], _repeated(*self.arcs[:4]))

        of, depots = _flat(column["depots"])
        at_depot = node(of, depots)
        _odd(self.odd, of, at_depot < 0)
        count = np.bincount(of, minlength=n)
        self.odd |= (count == 0) | ((count != 1) & (count < self.vehicles))
        self.depots, self.first_depot, self.many_depots = at_depot, np.cumsum(count) - count, count != 1

    def slices(self) -> Iterator[np.ndarray]:
        """Sound problems of like size, as many as fit the cells."""
        size = np.where(self.odd, 0, self.vehicles * (self.nodes + 2) * np.maximum(self.nodes, 1) * np.maximum(self.cases, 1))
        order = np.argsort(size, kind="stable")
        order = order[~self.odd[order]]
        low = 0
        while low < len(order):
            high = len(order)
            while high - low > 1 and self._cells(order[low:high]) > CELLS:
                high = low + (high - low + 1) // 2
            yield order[low:high]
            low = high

    def _cells(self, rows: np.ndarray) -> int:
        nodes = int(self.nodes[rows].max())
        return len(rows) * int(self.vehicles[rows].max()) * (nodes + 2) * max(nodes, 1) * max(int(self.cases[rows].max()), 1)

    def grown(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Routes of some problems, as places of nodes, and their lengths per vehicle (0: no such vehicle)."""
        n, s, v, p = int(self.nodes[rows].max()), max(int(self.cases[rows].max()), 1), int(self.vehicles[rows].max()), len(rows)
        own = np.full(len(self.odd), -1)
        own[rows] = np.arange(p)
        mine = own[self.of] >= 0
        at = own[self.of[mine]], self.place[mine]

        def spread(values: np.ndarray, missing) -> np.ndarray:
            out = np.full((p, max(n, 1)), missing, dtype=np.asarray(values).dtype)
            out[at] = values[mine]
            return out

        start, end, stay, demand, worth = (spread(self.values[c], 0.0) for c in ("start", "end", "stay", "demand", "worth"))
        free, rank = spread(self.free, False), spread(self.rank, 0)
        load = np.where(free, demand, 0.0)
        time = np.full((p, s, max(n, 1), max(n, 1)), np.inf)
        of, case, src, dst, cost = self.arcs
        kept = own[of] >= 0
        time[own[of[kept]], case[kept], src[kept], dst[kept]] = cost[kept]
        live, base = np.arange(s) < self.cases[rows][:, None], self.base[rows]
        vehicle = np.arange(v)
        there = vehicle < self.vehicles[rows][:, None]
        depot = self.depots[np.minimum(self.first_depot[rows][:, None] + np.where(self.many_depots[rows][:, None], vehicle, 0), len(self.depots) - 1)]
        stops = np.zeros((p, v, n + 2), np.int64)
        stops[:, :, 0], stops[:, :, 1] = depot, depot
        length = np.where(there, 1 + self.back[rows][:, None], 0)
        open_ = np.arange(p)
        while len(open_):
            data = [x[open_] for x in (time, start, end, stay, demand, worth, rank, load, live, base, self.back[rows], self.shift[rows], self.room[rows], self.tour[rows], free, stops, length)]
            found, at_vehicle, gap, node = _best(*data)
            open_, at_vehicle, gap, node = open_[found], at_vehicle[found], gap[found], node[found]
            line = stops[open_, at_vehicle]
            place = np.arange(line.shape[1])
            moved = np.concatenate([line[:, :1], line[:, :-1]], axis=1)
            stops[open_, at_vehicle] = np.where(place <= gap[:, None], line, np.where(place == gap[:, None] + 1, node[:, None], moved))
            length[open_, at_vehicle] += 1
            free[open_, node] = False
        return stops, length


def _best(time, start, end, stay, demand, worth, rank, load, live, base, back, shift, room, tour, free, stops, length):
    """Per problem whether a stop fits, and the vehicle, gap and node of the best one."""
    p, s = live.shape
    v, most = stops.shape[1], int(length.max())
    row, col, case = np.arange(p)[:, None], np.arange(p)[:, None, None], np.arange(s)
    stops = stops[:, :, :most]
    used = np.arange(most) < length[:, :, None]
    first = np.arange(most) == 0
    begin, until, wait = (np.where(first, x, y[col, stops]) for x, y in ((0.0, start), (np.inf, end), (0.0, stay)))
    hop = np.zeros((p, v, most, s))
    legs = time[np.arange(p)[:, None, None, None], case, stops[:, :, :-1, None], stops[:, :, 1:, None]]
    hop[:, :, 1:] = np.where((stops[:, :, :-1] == stops[:, :, 1:])[..., None], 0.0, legs)
    out, late, rest, least = (np.full((p, v, most + 1, s), x) for x in (0.0, np.inf, 0.0, -np.inf))
    for i in range(1, most):
        out[:, :, i] = np.maximum(out[:, :, i - 1] + hop[:, :, i], begin[:, :, i, None]) + wait[:, :, i, None]
    for i in range(most - 1, 0, -1):
        on, after = used[:, :, i, None], used[:, :, i + 1, None] if i + 1 < most else np.zeros((p, v, 1), bool)
        step = wait[:, :, i, None] + (hop[:, :, i + 1] if i + 1 < most else 0.0)
        rest[:, :, i] = np.where(on, np.where(after, step + rest[:, :, i + 1], wait[:, :, i, None]), 0.0)
        late[:, :, i] = np.where(on, np.minimum(until[:, :, i, None], np.where(after, late[:, :, i + 1] - step, np.inf)), np.inf)
        least[:, :, i] = np.where(on, np.maximum(begin[:, :, i, None] + rest[:, :, i], np.where(after, least[:, :, i + 1], -np.inf)), -np.inf)
    ends = np.take_along_axis(out, np.maximum(length - 1, 0)[:, :, None, None], axis=2)[:, :, 0]
    carried = np.where(used, load[col, stops], 0.0).sum(axis=2)

    # Axes: problem, vehicle, gap, node, scenario.
    follows = np.zeros((p, v, most), bool)
    follows[:, :, :-1] = used[:, :, 1:]
    following = np.where(follows, np.concatenate([stops[:, :, 1:], stops[:, :, :1]], axis=2), 0)
    n = time.shape[2]
    to = np.moveaxis(time[np.arange(p)[:, None, None, None], case, stops[..., None]], 3, 4)
    on = time[np.arange(p)[:, None, None, None, None], case, np.arange(n)[:, None], following[..., None, None]]
    arrive = np.maximum(out[:, :, :most, None] + to, start[:, None, None, :, None])
    done = arrive + stay[:, None, None, :, None]
    next_ = follows[..., None, None]
    then = np.maximum(done + on, np.concatenate([begin[:, :, 1:], begin[:, :, :1]], axis=2)[..., None, None])
    final = np.where(next_, np.maximum(then + rest[:, :, 1:, None], least[:, :, 1:, None]), done)
    fits = (arrive <= end[:, None, None, :, None] + TOLERANCE) & (~next_ | (then <= late[:, :, 1:, None] + TOLERANCE))
    fits &= (final <= shift[:, None, None, None, None] + TOLERANCE) & (final < np.inf)
    fits = (fits | ~live[:, None, None, None]).all(axis=4)
    fits &= (carried[:, :, None, None] + demand[:, None, None] <= room[:, None, None, None] + TOLERANCE) & free[:, None, None]
    fits &= (used & (follows | ~back[:, None, None]))[..., None]
    delta = np.round(np.take_along_axis(final, base[:, None, None, None, None], axis=4)[..., 0] - np.take_along_axis(ends, base[:, None, None], axis=2)[..., None], 9)
    is_tour = tour[:, None, None, None]
    gain = np.where(delta > TOLERANCE, worth[:, None, None] / np.where(delta > TOLERANCE, delta, 1.0), np.inf)
    keys = (np.where(is_tour, -delta, gain), np.broadcast_to(np.where(is_tour, 0.0, worth[:, None, None]), fits.shape), np.broadcast_to(-rank[:, None, None].astype(float), fits.shape))
    shape, fits = fits.shape, fits.reshape(p, -1)
    found = fits.any(axis=1)
    for k in keys:
        k = np.where(fits, k.reshape(p, -1), -np.inf)
        fits &= k == k.max(axis=1, keepdims=True)
    # What is left differs by vehicle and gap only, the first of which comes first.
    vehicle, gap, node = np.unravel_index(fits.argmax(axis=1), shape[1:])
    return found, vehicle, gap, node


def rounds(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Routes of packed problems, one row per vehicle; a problem that rows must treat has one row without vehicle."""
    for table in batches:
        if not table.num_rows:
            continue
        with np.errstate(invalid="ignore"):
            batch = Batch(table)
            first = np.cumsum(batch.nodes) - batch.nodes
            rows, vehicles, sizes, places = [], [], [], []
            for some in batch.slices():
                stops, length = batch.grown(some)
                problem, vehicle = np.nonzero(length)
                line, size = stops[problem, vehicle], length[problem, vehicle]
                rows.append(some[problem])
                vehicles.append(vehicle + 1)
                sizes.append(size)
                places.append((line + first[some[problem]][:, None])[np.arange(line.shape[1]) < size[:, None]])
        odd = np.flatnonzero(batch.odd)
        joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(joined(sizes))]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), batch.names.take(pa.array(joined(places))))
        out = {
            "problem_id": table.column("problem_id").take(pa.array(np.concatenate([joined(rows), odd]))),
            "vehicle": pa.concat_arrays([pa.array(joined(vehicles), pa.int32()), pa.nulls(len(odd), pa.int32())]),
            "node_ids": pa.concat_arrays([ids.cast(schema.field("node_ids").type), pa.nulls(len(odd), schema.field("node_ids").type)]),
        }
        yield pa.RecordBatch.from_pydict({f.name: out[f.name].cast(f.type) for f in schema}, schema=schema)
