"""melisma: symbolic-music corpus analytics as PySpark DataFrame operators."""
