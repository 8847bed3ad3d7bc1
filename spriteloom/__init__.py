"""spriteloom: pixel-art cleaning and colour analytics over Spark relations of images, pixels, colours and grid candidates."""
