"""Job parameters shared by the registered queries and their SQL oracles."""

SHARD_SIZE = 250_000          # tokens per shard for the driver-table corpus
CHUNK_SIZE = 65_536           # tokens per stored chunk row

# batch settings (num_tokens, max_seq_len, world_size, grad_accum)
BATCH_A = (16384, 896, 2, 4)
BATCH_B = (4096, 2048, 8, 1)

TOP_N = 20                    # extremes per metric in the reports
BLOCK = 128                   # attention block size for block document ranges
