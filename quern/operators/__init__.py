"""DataFrame operators: top-k, text ranking, nearest-neighbour indexes, recommender, media."""
