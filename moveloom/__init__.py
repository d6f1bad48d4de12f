"""moveloom: game-corpus analytics expressed as Spark DataFrame plans."""
