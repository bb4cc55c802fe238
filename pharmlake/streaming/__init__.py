"""Streaming: the reference has no stream operator. The stateless rule, validity and
text functions are plain column expressions, so they run unchanged on a
``readStream`` frame; ``stream_rules`` shows that on a file source."""
