"""Fixed, versioned schemas; nothing is inferred."""

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


METADATA = struct(typeIdentifier=S, primaryImageIndex=I, contentSHA256=S, byteCount=L, colorProfile=S, bitsPerComponent=I,
                  cameraMake=S, cameraModel=S, focalLengthMillimeters=D, captureDate=S)
PHOTO = struct(id=S, originalName=S, imagePath=S, thumbnailPath=S, pixelWidth=I, pixelHeight=I, orientation=I, metadata=METADATA)
SETTINGS = struct(quality=S, objectMasking=B)
MODEL = struct(path=S, createdAt=T.TimestampType(), settings=SETTINGS, photoIDs=T.ArrayType(S), runID=S, inputSnapshotPath=S)
MANIFEST = struct(formatVersion=I, id=S, name=S, createdAt=T.TimestampType(), modifiedAt=T.TimestampType(), settings=SETTINGS,
                  photos=T.ArrayType(PHOTO), model=MODEL, _corrupt=S)
SOURCE_PHOTO = struct(id=S, name=S, sourcePath=S, sourceSHA256=S)
PHOTO_USE = struct(photoID=S, sourceSHA256=S, role=S, reason=S)
TASK = struct(formatVersion=I, jobID=S, photos=T.ArrayType(SOURCE_PHOTO), allPhotos=T.ArrayType(SOURCE_PHOTO), photoUse=T.ArrayType(PHOTO_USE),
              runtime=T.MapType(S, S), parameters=struct(memoryGiB=D, modelSize=I, volumeResolution=I, textureSize=I))
VIEW = struct(id=S, name=S, sourcePath=S, sourceSHA256=S, encodedWidth=I, encodedHeight=I, encodedOrientation=I, uprightWidth=I, uprightHeight=I,
              workingWidth=I, workingHeight=I, image=S, mask=S, fullImage=S, fullMask=S, encodedToUprightPixels=T.ArrayType(D),
              encodedToWorkingPixels=T.ArrayType(D), workingSHA256=S, maskSHA256=S, fullImageSHA256=S, fullMaskSHA256=S, selectedInstance=I,
              instanceCandidates=T.ArrayType(struct(label=I, centerScore=D, pixels=L)))
DATASET = struct(formatVersion=I, kind=S, records=T.ArrayType(VIEW))
MATCH_SET = struct(pairs=T.ArrayType(struct(names=T.ArrayType(S), pointsA=T.ArrayType(T.ArrayType(D)), pointsB=T.ArrayType(T.ArrayType(D)))))
REGIONS = struct(regions=T.ArrayType(struct(id=S, photo=S, box=T.ArrayType(D), polygon=T.ArrayType(T.ArrayType(D)), surface=S, detail=S)),
                 backgroundPolygons=T.MapType(S, T.ArrayType(T.ArrayType(T.ArrayType(D)))), lowerBoundaryMarginWorkingPixels=D,
                 perPhotoLowerBoundaryMarginWorkingPixels=T.MapType(S, D), lowerBoundaryMarginStartsAtWorkingY=D, manualExclusionMarginWorkingPixels=D,
                 instrumentSkyExclusion=struct(boxes=T.MapType(S, T.ArrayType(D)), blueRedRatio=D, blueGreenRatio=D, minimumBlueMinusRed=D, fullPixelMargin=I))
SAMPLE = struct(job_id=S, stage=S, seconds=D, rssBytes=L, mpsDriverBytes=L)
GRID = struct(scene_id=L, view_id=I, width=I, depth=T.ArrayType(T.FloatType()), confidence=T.ArrayType(T.FloatType()), mask=T.ArrayType(B))
VERTEX = struct(scene_id=L, vid=L, x=D, y=D, z=D)
FACE = struct(scene_id=L, fid=L, v0=L, v1=L, v2=L, completion=B)
