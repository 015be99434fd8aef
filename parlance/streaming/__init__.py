"""Model output as a stream: parser, event generators, accumulators, batch and Structured Streaming forms."""
