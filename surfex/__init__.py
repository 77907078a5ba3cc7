"""Surface evidence tables on Spark: photos, cameras, pixels, voxels, meshes, texels, artifacts and job events."""
