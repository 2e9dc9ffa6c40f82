"""Analytics over HTTP Live Streaming data as Spark DataFrames: playlists, timed samples, audio, delivery."""
