"""Named queries of the engine, each with its SQL counterpart where SQL can express it."""
