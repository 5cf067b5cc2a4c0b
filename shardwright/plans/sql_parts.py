"""Common table expressions of the DuckDB oracles (byte encoder corpus).

They restate the operators' semantics in plain SQL over the driver tables;
the Spark side never uses them.
"""

from .params import SHARD_SIZE

S = SHARD_SIZE

# corpus -> offsets -> pieces
OFFSETS = f"""
lens AS (SELECT doc_id AS doc_ord, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens FROM documents),
offs AS (SELECT doc_ord, n_tokens,
                CAST(sum(n_tokens) OVER (ORDER BY doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS BIGINT) AS doc_offset
         FROM lens)"""

PIECES = OFFSETS + f""",
pieces0 AS (SELECT doc_ord, n_tokens, doc_offset,
                   unnest(range(doc_offset // {S}, (doc_offset + n_tokens - 1) // {S} + 1)) AS shard_id
            FROM offs),
pieces AS (SELECT doc_ord, n_tokens, doc_offset, shard_id,
                  greatest(doc_offset, shard_id * {S}) - doc_offset AS doc_start,
                  greatest(doc_offset, shard_id * {S}) - shard_id * {S} AS shard_pos,
                  least(doc_offset + n_tokens, (shard_id + 1) * {S}) - greatest(doc_offset, shard_id * {S}) AS piece_len
           FROM pieces0)"""

# delimiter positions = first piece of every document
DELIMS = PIECES + f""",
delims AS (SELECT shard_id, CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END AS split,
                  printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem,
                  shard_pos AS pos, doc_ord
           FROM pieces WHERE doc_start = 0),
shard_sizes AS (SELECT shard_id, sum(piece_len) AS shard_len FROM pieces GROUP BY shard_id)"""

# training spans (D2): delimiter to next delimiter, last one to the shard end
TRAIN_SPANS = DELIMS + """,
train_spans AS (SELECT d.shard_id, d.shard_stem,
                       CAST(row_number() OVER (PARTITION BY d.shard_id ORDER BY d.pos) - 1 AS BIGINT) AS doc_idx,
                       d.pos AS start_idx,
                       coalesce(lead(d.pos) OVER (PARTITION BY d.shard_id ORDER BY d.pos), s.shard_len) AS end_idx
                FROM delims d JOIN shard_sizes s USING (shard_id))"""

# byte tokens of every document, delimiter first
DOC_TOKENS = """
doc_tokens AS (SELECT doc_id AS doc_ord,
                      [50256] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INTEGER) AS toks
               FROM documents)"""

# the whole token stream, one row per token with shard and position (after PIECES)
STREAM_ROWS = DOC_TOKENS + """,
doc_tok_rows AS (SELECT doc_ord, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM doc_tokens),
token_rows AS (SELECT p.shard_id, p.shard_pos + (t.i - p.doc_start) AS pos, t.tok, t.doc_ord
               FROM pieces p JOIN doc_tok_rows t
                 ON t.doc_ord = p.doc_ord AND t.i >= p.doc_start AND t.i < p.doc_start + p.piece_len)"""
TOKEN_ROWS = PIECES + "," + STREAM_ROWS

# ---- batch plans ----------------------------------------------------------


def aligned_plan(n_local: int, max_seq_len: int, world_size: int, grad_accum: int) -> str:
    """Aligned batch plan rows as ``plan`` (needs TRAIN_SPANS before it)."""
    need = n_local + 1
    return f""",
sp AS (SELECT shard_id, shard_stem, doc_idx, start_idx, end_idx, least(end_idx - start_idx, {max_seq_len}) AS L
       FROM train_spans WHERE shard_id > 0),
pp AS (SELECT *, sum(L) OVER (PARTITION BY shard_id ORDER BY doc_idx ROWS UNBOUNDED PRECEDING) - L AS P FROM sp),
tot AS (SELECT shard_id, sum(L) AS total, count(*) AS n FROM sp GROUP BY shard_id),
pts AS (SELECT shard_id, doc_idx AS j, P FROM pp UNION ALL SELECT shard_id, n AS j, total AS P FROM tot),
nxt AS (SELECT a.shard_id, a.j AS s, a.P AS ps, min(b.j) AS nj
        FROM pts a JOIN pts b ON a.shard_id = b.shard_id AND b.P >= a.P + {need}
        GROUP BY a.shard_id, a.j, a.P),
walk AS (SELECT n.shard_id, 0::BIGINT AS k, n.s, n.ps, n.nj FROM nxt n WHERE n.s = 0
         UNION ALL
         SELECT w.shard_id, w.k + 1, n.s, n.ps, n.nj FROM walk w JOIN nxt n ON n.shard_id = w.shard_id AND n.s = w.nj),
pieces_k AS (SELECT w.shard_id, w.k AS slice_k, p.doc_idx, p.start_idx,
                    CASE WHEN p.doc_idx = w.nj - 1 THEN p.start_idx + (w.ps + {need} - p.P)
                         ELSE p.start_idx + p.L END AS end_idx,
                    p.shard_stem, (p.doc_idx - w.s)::INTEGER AS piece
             FROM walk w JOIN pp p ON p.shard_id = w.shard_id AND p.doc_idx >= w.s AND p.doc_idx < w.nj),
calls AS (SELECT shard_id, (max(slice_k) + 1) // {world_size} AS n_calls FROM pieces_k GROUP BY shard_id),
cb AS (SELECT shard_id, n_calls, sum(n_calls) OVER (ORDER BY shard_id ROWS UNBOUNDED PRECEDING) - n_calls AS call_base FROM calls),
plan AS (SELECT ((cb.call_base + p.slice_k // {world_size}) // {grad_accum})::BIGINT AS step,
                ((cb.call_base + p.slice_k // {world_size}) % {grad_accum})::INTEGER AS micro,
                (p.slice_k % {world_size})::INTEGER AS rank,
                p.shard_id::INTEGER AS shard_id, p.shard_stem, p.slice_k::BIGINT AS slice_k, p.piece,
                p.doc_idx::BIGINT AS doc_idx, p.start_idx::BIGINT AS start_idx, p.end_idx::BIGINT AS end_idx
         FROM pieces_k p JOIN cb USING (shard_id)
         WHERE p.slice_k < cb.n_calls * {world_size})"""


def staged_plan(stages: list[tuple[int, int, int]], world_size: int, grad_accum: int) -> str:
    """Plan rows as ``plan`` for stages (first step, tokens a step, longest document); needs TRAIN_SPANS before it.

    ``made`` follows the loader call by call, shard after shard.
    """
    rows = ", ".join(f"({j}, {first * grad_accum}, {tokens // grad_accum // world_size + 1}, {longest})"
                     for j, (first, tokens, longest) in enumerate(stages))
    hops = "".join(f" JOIN nxt n{r} ON n{r}.stage = n{r - 1}.stage AND n{r}.shard_id = n{r - 1}.shard_id AND n{r}.s = n{r - 1}.nj"
                   for r in range(1, world_size))
    edges = ", ".join(f"n{r}.s" for r in range(world_size))
    return f""",
stages(stage, first_call, need, longest) AS (VALUES {rows}),
sp AS (SELECT stage, need, shard_id, shard_stem, doc_idx, start_idx, least(end_idx - start_idx, longest) AS L
       FROM train_spans, stages WHERE shard_id > 0),
pp AS (SELECT *, sum(L) OVER (PARTITION BY stage, shard_id ORDER BY doc_idx ROWS UNBOUNDED PRECEDING) - L AS P FROM sp),
pts AS (SELECT stage, need, shard_id, doc_idx AS j, P FROM pp
        UNION ALL SELECT stage, any_value(need), shard_id, count(*), sum(L) FROM sp GROUP BY stage, shard_id),
nxt AS (SELECT a.stage, a.shard_id, a.j AS s, min(b.j) AS nj
        FROM pts a JOIN pts b ON a.stage = b.stage AND a.shard_id = b.shard_id AND b.P >= a.P + a.need
        GROUP BY a.stage, a.shard_id, a.j),
hops AS (SELECT n0.stage, n0.shard_id, n0.s AS at, n{world_size - 1}.nj AS after, [{edges}, n{world_size - 1}.nj] AS edges
         FROM nxt n0{hops}),
shards AS (SELECT shard_id, row_number() OVER (ORDER BY shard_id) AS ord FROM (SELECT DISTINCT shard_id FROM sp)),
made AS (SELECT 1::BIGINT AS ord, 0::BIGINT AS at, 0::BIGINT AS call, NULL::BIGINT AS made_call, NULL::INTEGER AS stage,
                NULL::BIGINT[] AS edges, NULL::BIGINT AS shard_id
         UNION ALL
         SELECT CASE WHEN h.at IS NULL THEN m.ord + 1 ELSE m.ord END, coalesce(h.after, 0),
                CASE WHEN h.at IS NULL THEN m.call ELSE m.call + 1 END, CASE WHEN h.at IS NOT NULL THEN m.call END,
                h.stage, h.edges, h.shard_id
         FROM made m JOIN shards ON shards.ord = m.ord
              LEFT JOIN hops h ON h.shard_id = shards.shard_id AND h.at = m.at
                               AND h.stage = (SELECT max(stage) FROM stages WHERE first_call <= m.call)),
slices AS (SELECT made_call, stage, shard_id, unnest(range({world_size})) AS rank, edges FROM made WHERE made_call IS NOT NULL),
plan AS (SELECT (made_call // {grad_accum})::BIGINT AS step, (made_call % {grad_accum})::INTEGER AS micro, rank::INTEGER AS rank,
                c.stage::INTEGER AS stage, c.shard_id::INTEGER AS shard_id, p.shard_stem, (p.doc_idx - edges[rank + 1])::INTEGER AS piece,
                p.doc_idx::BIGINT AS doc_idx, p.start_idx::BIGINT AS start_idx,
                (CASE WHEN p.doc_idx = edges[rank + 2] - 1 THEN p.start_idx + f.P + p.need - p.P
                      ELSE p.start_idx + p.L END)::BIGINT AS end_idx
         FROM slices c JOIN pp p ON p.stage = c.stage AND p.shard_id = c.shard_id
                                    AND p.doc_idx >= edges[rank + 1] AND p.doc_idx < edges[rank + 2]
              JOIN pp f ON f.stage = c.stage AND f.shard_id = c.shard_id AND f.doc_idx = edges[rank + 1])"""


def unaligned_slices(num_tokens: int, world_size: int, grad_accum: int) -> str:
    """Unaligned windows as ``uslices`` (needs DELIMS before it)."""
    B = num_tokens // grad_accum
    n_local = B // world_size
    return f""",
ucalls AS (SELECT shard_id, shard_stem_of_size AS shard_stem, shard_len,
                  greatest((shard_len - {B} - 2) // {B} + 1, 0)::BIGINT AS n_calls
           FROM (SELECT shard_id, shard_len,
                        printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem_of_size
                 FROM shard_sizes)),
ucb AS (SELECT *, (sum(n_calls) OVER (ORDER BY shard_id ROWS UNBOUNDED PRECEDING) - n_calls)::BIGINT AS call_base FROM ucalls),
uk AS (SELECT shard_id, shard_stem, call_base, unnest(range(n_calls)) AS k FROM ucb WHERE n_calls > 0),
uslices AS (SELECT ((call_base + k) // {grad_accum})::BIGINT AS step, ((call_base + k) % {grad_accum})::INTEGER AS micro,
                   r::INTEGER AS rank, shard_id::INTEGER AS shard_id, shard_stem,
                   (k * {B} + r * {n_local})::BIGINT AS slice_start,
                   (k * {B} + r * {n_local} + {n_local} + 1)::BIGINT AS slice_end
            FROM uk, range({world_size}) t(r))"""

# token stream and training spans together
TOKEN_ROWS_SPANS = TRAIN_SPANS + "," + STREAM_ROWS
