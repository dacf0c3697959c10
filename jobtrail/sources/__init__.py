from jobtrail.sources.commits import read_batches, replaced, write_batch
from jobtrail.sources.log import append_log, read_log
from jobtrail.sources.outbox import outbox_sink, read_outbox, write_outbox
from jobtrail.sources.postings import add_postings, read_postings
from jobtrail.sources.shared import new_folder, stored, stored_by
from jobtrail.sources.tables import dealt, read_table, scan_pages, spread, stream_table

__all__ = [
    "add_postings",
    "append_log",
    "dealt",
    "new_folder",
    "outbox_sink",
    "read_batches",
    "read_log",
    "read_outbox",
    "read_postings",
    "read_table",
    "replaced",
    "scan_pages",
    "spread",
    "stored",
    "stored_by",
    "stream_table",
    "write_batch",
    "write_outbox",
]
