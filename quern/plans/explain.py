"""EXPLAIN: the chain of operators in the dialect's words, with estimated rows and pages, above Catalyst's own plan."""

from __future__ import annotations

from dataclasses import dataclass

from quern.functions.numbers import point_text, text_of
from quern.plans.parser import Condition, PointValue, Statement
from quern.sources.catalog import Table


# The names of nodes ("Seq Scan on", "Key Lookup on", "Hash Join", ...) are fixed values of the dialect.
# Height of an index where none is known, and shares of a table's rows that conditions are taken to leave.
HEIGHT, EQUAL, OTHER = 3, 200, 10


@dataclass
class Node:
    """part: whose rows EXPLAIN ANALYZE counts. cost: pages that are expected to be read, as far up as this node."""

    name: str
    detail: str = ""  # the line under the name
    rows: int = -1
    actual: int = -1
    level: int = 0
    cost: float = -1
    part: str = ""

    def lines(self) -> str:
        pad = "  " * self.level + ("-> " if self.level else "")
        guess = f"cost={self.cost:.2f} rows={self.rows}" if self.cost >= 0 else f"rows={self.rows}"
        out = pad + self.name + (f"  ({guess})" if self.rows >= 0 else "") + (f" (actual rows={self.actual})" if self.actual >= 0 else "")
        return out + (f"\n{' ' * len(pad)}{self.detail}" if self.detail else "")


def centre_text(c) -> str:
    return point_text(c.lat_e6, c.lon_e6) if isinstance(c, PointValue) else text_of(list(c.items))


def condition_text(c: Condition) -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else text_of(v)
    if c.op == "INSIDE":
        return f"dentro({c.column}, POLYGON with {len(c.polygon)} corners)"
    if c.centre is not None:
        return f"distancia({c.column}, {centre_text(c.centre)}, {c.metric.lower()}) {c.op} {value(c.value)}"
    return f"{c.column} BETWEEN {value(c.value)} AND {value(c.upper)}" if c.op == "BETWEEN" else f"{c.column} {c.op} {value(c.value)}"


def access(table: Table, s: Statement, conditions: list[Condition], rows: int, pages: int, side: str = "") -> tuple[list[Node], int]:
    """The access node of one table and, above it, the filter for what it does not settle; and the rows expected."""
    used, node, expected = -1, None, rows
    aggregates = bool(s.group_by) or any(i.aggregate for i in s.items)
    by_index = lambda n: HEIGHT + float(n)
    for k, c in enumerate(conditions):
        column = table.column(c.column.rpartition(".")[2])
        if c.op == "INSIDE" or c.centre is not None:
            index = table.index(column.name, "RTREE")
            bounded = c.op == "INSIDE" or (isinstance(c.centre, PointValue) and c.op in ("<", "<="))
            if index and bounded:
                used, expected = k, max(1, rows // OTHER)
                node = Node(f"Spatial Index Scan using {index.name} on {table.name} ({column.name})", f"Index Cond: {condition_text(c)}", expected, cost=by_index(expected))
                break
            continue
        if c.op == "!=":
            continue
        equal = c.op == "=" or (c.op == "BETWEEN" and c.value == c.upper)
        index = table.index(column.name, "BPLUS", "HASH")
        index = None if index and index.kind == "HASH" and not equal else index
        ordered = column.key and table.organization != "HEAP"
        if ordered or index:
            used, expected = k, (1 if column.key else max(1, rows // EQUAL)) if equal else width(c, rows)
            if ordered:
                cost = HEIGHT if equal else HEIGHT + min(pages, max(1.0, pages * expected / rows if rows else pages))
                node = Node(f"{'Key Lookup' if equal else 'Ordered Key Scan'} on {table.name}", f"Key Cond: {condition_text(c)}", expected, cost=cost)
            else:
                node = Node(f"Index {'' if equal else 'Range '}Scan using {index.name} on {table.name} ({column.name})", f"Index Cond: {condition_text(c)}", expected, cost=by_index(expected))
            break
    if node is None and not conditions and not aggregates and s.order_by and not s.descending and s.limit and s.order_centre is not None:
        index = table.index(s.order_by, "RTREE")
        if index or not isinstance(s.order_centre, PointValue):
            name = f"Spatial k-NN Scan using {index.name} on {table.name} ({index.column})" if index else f"Seq Vector Scan on {table.name} ({s.order_metric.lower()})"
            expected = min(s.limit, rows)
            node = Node(name, f"Order By: distancia({s.order_by}, {centre_text(s.order_centre)}) LIMIT {s.limit}", expected, cost=by_index(expected) if index else float(pages))
    if node is None and not conditions and not aggregates and s.order_by and s.order_centre is None and (index := table.index(s.order_by, "BPLUS")):
        node = Node(f"Ordered Index Scan using {index.name} on {table.name} ({index.column})", "", rows, cost=by_index(rows))
    if node is None:
        node = Node(f"Seq Scan on {table.name}", "", rows, cost=float(pages), part=f"scan{side}")
    rest = [c for k, c in enumerate(conditions) if k != used]
    out = [node]
    if rest:
        expected = max(1, expected // OTHER)
        out.append(Node("Filter", "Filter: " + " AND ".join(map(condition_text, rest)), expected, cost=node.cost, part=f"filter{side}"))
    elif used >= 0:
        node.part = f"filter{side}"
    return out, expected


def width(c: Condition, rows: int) -> int:
    """Rows of a range, as if keys were whole numbers without gaps; all for an open one, a share of the table for other keys."""
    if not isinstance(c.value, int):
        return max(1, rows // OTHER)
    return max(1, min(rows, c.upper - c.value + 1)) if c.op == "BETWEEN" else rows


def plan(s: Statement, tables: list[Table], counts: list[int], pages: list[int]) -> list[Node]:
    """Nodes from the root down. counts and pages: rows and pages of the tables."""
    up: list[Node] = []
    below: list[list[Node]] = []
    if s.kind == "select" and s.join:
        expected, cost = 1, 0.0
        for k, (table, n, names) in enumerate(zip(tables, counts, ((s.table, s.alias), (s.join, s.join_alias)), strict=True)):
            own = [c for c in s.where if ("." not in c.column and any(x.name.upper() == c.column.upper() for x in table.columns)) or c.column.partition(".")[0].upper() in {x.upper() for x in names if x}]
            nodes, e = access(table, Statement("scan"), own, n, pages[k], str(k))
            below.append(nodes[::-1])
            cost += nodes[0].cost
            expected = max(expected, e)
        indexed = [k for k in (0, 1) for c in s.on if (i := c.rpartition(".")[2]) and any(x.name.upper() == i.upper() for x in tables[k].columns) and (tables[k].index(i, "BPLUS", "HASH") or (tables[k].column(i).key and tables[k].organization != "HEAP"))]
        inner = next((k for k in indexed if counts[1 - k] <= counts[k]), None)
        cond = f"{s.on[0]} = {s.on[1]}"
        up.append(Node("Hash Join", f"Hash Cond: {cond}", expected, cost=cost, part="join") if inner is None else Node("Index Nested Loop Join", f"Join Cond: {cond}", expected, cost=cost, part="join"))
    elif s.kind == "select" and s.match:
        index = tables[0].index(s.match[0], "SPIMI")
        best = s.limit and not s.where and (not s.order_by or s.descending)
        expected = min(counts[0], s.limit) if best else max(1, counts[0] // OTHER)
        up.append(Node(f"Text Index Scan using {index.name if index else '?'} on {tables[0].name} ({s.match[0]})", f"Index Cond: MATCH('{s.match[1]}') {s.ranking}", expected, cost=HEIGHT + float(expected), part="text"))
        if s.where:
            expected = max(1, expected // OTHER)
            up.append(Node("Filter", "Filter: " + " AND ".join(map(condition_text, s.where)), expected, cost=up[0].cost, part="filter"))
    elif s.kind == "select" and s.similar:
        column = s.similar_column or next((c.name for c in tables[0].columns if c.kind == "VECTOR"), "?")
        if s.similar_index:
            index = tables[0].index(column, s.similar_index)
            setting = f"ef={index.options['ef_busqueda']}" if s.similar_index == "HNSW" else f"nprobe={index.options['nprobe']}"
            expected = min(counts[0], s.similar_k)
            up.append(Node(f"Vector Scan using {index.name} on {tables[0].name} ({s.similar_index}, {s.similar_metric.lower()}, {setting})", f"Order By: SIMILAR_TO({column}, k={s.similar_k})", expected, cost=HEIGHT + float(expected)))
            if s.where:
                expected = max(1, expected // OTHER)
                up.append(Node("Filter", "Filter: " + " AND ".join(map(condition_text, s.where)), expected, cost=up[0].cost))
        elif s.where:
            nodes, expected = access(tables[0], Statement("scan"), s.where, counts[0], pages[0])
            up += nodes
            expected = min(expected, s.similar_k)
            up.append(Node(f"Top-k on {tables[0].name} ({s.similar_metric.lower()})", f"Order By: SIMILAR_TO({column}, k={s.similar_k})", expected, cost=up[0].cost))
        else:
            expected = min(counts[0], s.similar_k)
            up.append(Node(f"Seq Vector Scan on {tables[0].name} ({s.similar_metric.lower()})", f"Order By: SIMILAR_TO({column}, k={s.similar_k})", expected, cost=float(pages[0])))
    else:
        nodes, expected = access(tables[0], s, s.where, counts[0], pages[0])
        up += nodes
    cost = up[0].cost
    if s.kind == "delete":
        up.append(Node(f"Delete on {tables[0].name}", "", expected, cost=cost))
    else:
        if s.group_by or any(i.aggregate for i in s.items):
            expected = max(1, expected // OTHER) if s.group_by else 1
            up.append(Node("HashAggregate", f"Group Key: {s.group_by}" if s.group_by else "", expected, cost=cost, part="group"))
        if s.order_by and not any(x in up[0].name for x in ("k-NN", "Seq Vector", "Ordered Index")):
            up.append(Node("Sort", f"Sort Key: {s.order_by}{' DESC' if s.descending else ''}", expected, cost=cost))
        if s.limit is not None:
            up.append(Node("Limit", "", min(expected, s.limit), cost=cost))
    out = up[::-1]
    for k, n in enumerate(out):
        n.level = k
    for nodes in below:
        for k, n in enumerate(nodes):
            n.level = len(out) + k
    return out + [n for nodes in below for n in nodes]
