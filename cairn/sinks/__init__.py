"""What tables become outside: files of single rows, standard objects, meshes, pictures and results."""
