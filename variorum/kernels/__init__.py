"""Plain-Python kernels of the apparatus grammars: no Spark here, so each is tested alone and wrapped once."""
