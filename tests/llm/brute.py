"""Plain versions of operators, for small inputs."""

from siltstone.llm import darts, line_dedup


def near_classes(rows, threshold=0.8):
    """doc_id → least doc_id of its class, comparing all pairs."""
    cells = [darts.shingle_cells(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or darts.similarity(cells[i], cells[j]) >= threshold - 1e-12:
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def kept_lines(rows, least):
    """doc_id → (number of lines, lines that stay)."""
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda line: line.strip(line_dedup.BLANKS).translate(low)
    count = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            count[k] = count.get(k, 0) + 1
    return {i: (len((t or "").split("\n")), [x for x in (t or "").split("\n") if key(x) == "" or count[key(x)] < least]) for i, t in rows}
