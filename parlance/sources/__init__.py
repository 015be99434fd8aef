"""Sources and sinks: requests, corpora, chunks, tokenizer files, data URLs, frames."""
