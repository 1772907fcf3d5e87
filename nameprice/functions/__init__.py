"""Column builders: lexicon, text cleaning, tokenising, feature families."""
