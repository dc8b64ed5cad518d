from .stream_score import score_batch, start_stream_score  # noqa: F401
