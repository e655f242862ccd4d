"""A plain model of clustering and of missed modes, from their definitions."""
from collections import Counter, defaultdict


def bp(a, b):
    return max(0, min(a[1], b[1]) - max(a[0], b[0]))


def score1(a, b):
    u = a[1] - a[0] + b[1] - b[0] - bp(a, b)
    return bp(a, b) / u if u else 0.0


def score2(a, b):
    m = max(a[1] - a[0], b[1] - b[0])
    return bp(a, b) / m if m else 0.0


def cluster(reads, t1=0.95, t2=0.8, tol=12, max5=None, attach=True):
    """reads: (contig, strand, start, end, id); returns sorted (contig, strand, start, end, number of reads)."""
    by = defaultdict(list)
    for c, s, a, b, i in reads:
        by[c, s].append((a, b, i))
    out = []
    for (c, s), rows in by.items():
        root = list(range(len(rows)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                same = rows[i][:2] == rows[j][:2] and rows[i][0] < rows[i][1]
                if same or (bp(rows[i], rows[j]) > 0 and score1(rows[i], rows[j]) >= t1):
                    root[find(i)] = find(j)
        groups = defaultdict(list)
        for i in range(len(rows)):
            groups[find(i)].append(rows[i])
        reps = {k: min(v, key=lambda r: (r[0] - r[1], r[2], r[0], r[1])) for k, v in groups.items()}
        up = {}
        for k, x in reps.items():
            ok = []
            for m, d in reps.items():
                three = d[0] <= x[0] + tol if s == "-" else d[1] + tol >= x[1]
                delta = max(0, d[1] - x[1] if s == "-" else x[0] - d[0])
                good = score2(d, x) >= t2 or (max5 is not None and delta <= max5)
                if d[0] < x[0] < d[1] and d[1] - d[0] > x[1] - x[0] > 0 and three and good:
                    ok.append((-score2(d, x), -score1(d, x), d[2], d[0], d[1], m))
            if ok and attach:
                up[k] = min(ok)[-1]
        n = Counter()
        for k, v in groups.items():
            while k in up:
                k = up[k]
            n[k] += len(v)
        out += [(c, s, reps[k][0], reps[k][1], n[k]) for k in n]
    return sorted(out)


def peaks(counts, minus, window, most):
    left, out = dict(counts), []
    while left:
        pri = lambda k: k if minus else -k
        k = max(left, key=lambda k: (sum(v for x, v in left.items() if abs(x - k) <= window), left[k], pri(k)))
        out.append((k, sum(v for x, v in left.items() if abs(x - k) <= window)))
        left = {x: v for x, v in left.items() if abs(x - k) > window}
    out.sort(key=lambda x: (-x[1], x[0] if not minus else -x[0]))
    return out[:most]
